"""What the text classifiers share: tokens with their shapes, bounded samples, small numpy models."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words, and runs of marks.
TOKEN = re.compile(r"\w+|[^\w\s]+")


def hashed_to(s: str, size: int) -> int:
    """A stable number below ``size``."""
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % size


class Hasher:
    """Stable numbers for strings, remembered up to a bound."""

    def __init__(self, size: int, most: int = 400_000):
        self.size, self.most, self.known = size, most, {}

    def __call__(self, strings: list[str]) -> np.ndarray:
        known = self.known
        found = list(map(known.get, strings))
        if None in found:
            if len(known) > self.most:
                known.clear()
            for s in set(strings).difference(known):
                known[s] = hashed_to(s, self.size)
            found = list(map(known.__getitem__, strings))
        return np.array(found, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Sparse rows of ones: indices one after another, and where each row starts."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(self.n), self.size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row], minlength=size)


def off_expectation(rows: Rows, y: np.ndarray, size: int, use: np.ndarray) -> np.ndarray:
    """For each feature, by how many deviations its rows with y = 1 are more than its share of them."""
    m = use.astype(float)
    expected = rows.back(m, size) * (float((y * m).sum()) / max(float(m.sum()), 1))
    return (rows.back(y * m, size) - expected) / np.sqrt(expected + 0.5)


def fit_linear(rows: Rows, more: np.ndarray, y: np.ndarray, size: int, use: np.ndarray, steps: int = 80, rate: float = 0.4, ridge: float = 1e-5, clear: float = 3.0) -> np.ndarray:
    """Logistic weights (features, then the columns of ``more``, then the bias) by AdaGrad over the rows ``use``.

    Features whose share among the rows with y = 1 is not clearly (``clear`` deviations) off get none.
    """
    width, m = more.shape[1], use.astype(float)
    ones, n = float((y * m).sum()), float(m.sum())
    live = np.flatnonzero(np.abs(off_expectation(rows, y, size, use)) > clear)
    place = np.full(size, -1)
    place[live] = np.arange(len(live))
    keep = (place[rows.at] >= 0) & use[rows.row]
    at, row = place[rows.at][keep], rows.row[keep]
    w, seen = np.zeros(len(live) + width + 1), np.full(len(live) + width + 1, 1e-8)
    balance = np.where(y > 0, 0.5 / max(ones, 1), 0.5 / max(n - ones, 1)) * m
    for _ in range(steps):
        p = sigmoid(np.bincount(row, weights=w[at], minlength=rows.n) + more @ w[len(live) : len(live) + width] + w[-1])
        g = (p - y) * balance
        grad = np.concatenate([np.bincount(at, weights=g[row], minlength=len(live)), more.T @ g, [g.sum()]]) + ridge * w
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
    out = np.zeros(size + width + 1)
    out[live], out[size:] = w[: len(live)], w[len(live) :]
    return out


def scores(rows: Rows, more: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    width = more.shape[1]
    return sigmoid(rows.dot(w[:size]) + more @ w[size : size + width] + w[-1])


def sampled_labels(docs: DataFrame, labels: DataFrame, most: int, mark: str, allowed: Column | None = None) -> DataFrame:
    """(doc_id, _mark, _text) of at most ``most`` labelled documents, the same ones for the same tables.

    Rows without id or mark are no labels; of several marks of one id the greatest counts, of
    several texts under one id the one with the least hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(mark).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy("doc_id").agg(F.max(mark).cast("double").alias("_mark"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_mark").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))


def with_features(sample: DataFrame, of_texts: Callable[[list[str]], list[np.ndarray]], kind: str = "binary") -> DataFrame:
    """(doc_id, _mark, x): the features of each sampled text, as bytes or as an array, made where the texts lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = of_texts(batch.column(2).to_pylist())
            x = pa.array([v.tobytes() for v in found], pa.binary()) if kind == "binary" else pa.array([v.astype(np.int32) for v in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], x], ["doc_id", "_mark", "x"])

    id_kind = sample.schema["doc_id"].dataType.simpleString()
    return stored(sample.select("doc_id", "_mark", "_text").mapInArrow(run, f"doc_id {id_kind}, _mark double, x {kind}"), "sample-features")


def fitted(features: DataFrame, fit: Callable[[list[bytes], np.ndarray], np.ndarray]) -> np.ndarray:
    """``fit(features, marks)`` in one task over a bounded sample in a fixed order; the weights come back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        both = pd.concat(held) if held else pd.DataFrame({"_mark": [], "x": []})
        flat = fit(both["x"].tolist(), both["_mark"].to_numpy(float)).astype(np.float32)
        for at in range(0, len(flat), 1 << 18):
            yield pd.DataFrame({"at": [at], "w": [flat[at : at + (1 << 18)].tobytes()]})

    parts = features.orderBy(F.xxhash64("doc_id"), "doc_id").select("_mark", "x").coalesce(1).mapInPandas(run, "at long, w binary").collect()  # a few MB, whatever the input
    if not parts:  # no labelled row, no task
        return fit([], np.empty(0)).astype(np.float32)
    return np.frombuffer(b"".join(bytes(r["w"]) for r in sorted(parts, key=lambda r: r["at"])), np.float32)


def with_columns(docs: DataFrame, new: dict[str, str], of_texts: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """``docs`` with the columns ``new`` (name to type) that ``of_texts`` makes of the whole texts of a batch.

    A column of ``docs`` that is named like a new one gives way to it; any other name is carried as it is.
    """
    kept = [c for c in docs.columns if c not in new]
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col("text").cast("string").alias("own_text"))
    names = [*(f"c{i}" for i in range(len(kept))), *(f"n{i}" for i in range(len(new)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *of_texts(batch.column(batch.num_columns - 1).to_pylist())], names)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own.schema[:-1]), *(f"n{i} {t}" for i, t in enumerate(new.values()))])
    return own.mapInArrow(run, schema).toDF(*kept, *new)
