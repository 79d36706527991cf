"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word has a sparse random index vector; its context vector is the sum of the index vectors of
its neighbours over the whole corpus. Words are hashed to a fixed number of rows, so the sums of all
tasks have one size: each task adds up its own texts first, and then its rows are added to those of
the other tasks, by row. A document is pooled from the index and the context
vectors of its words, and of the marks that describe how words are written (capitals, repetition,
runs of signs). The network's logits are divided by a temperature fitted on rows left out of the
training.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textmodel import TOKEN, fitted, hashed_to, sampled_labels, sigmoid, with_columns, with_features

WORDS, WIDTH, ONES = 1 << 14, 64, 6
POOLED = 3 * WIDTH + 3
HIDDEN, SAMPLE, THRESHOLD = 48, 16000, 0.7
#: Rows that are added up together, and tokens that are handled at a time.
LANE, AT_ONCE = 32, 100_000
#: Different tokens that a worker remembers; beyond it the memory starts anew.
MEMORY = 400_000


def index_places() -> tuple[np.ndarray, np.ndarray]:
    """Where each row's index vector is 1 or -1, and which of the two (always the same)."""
    rng = np.random.default_rng(20240101)
    return rng.integers(0, WIDTH, (WORDS, ONES)), rng.choice(np.array([-1.0, 1.0]), (WORDS, ONES))


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """The random index vectors as a matrix."""
    place, sign = index_places()
    out = np.zeros((WORDS, WIDTH), np.float32)
    for j in range(ONES):
        out[np.arange(WORDS), place[:, j]] += sign[:, j]
    return out


def word_row(word: str) -> int:
    return hashed_to(word.lower(), WORDS)


#: The mark of a word that stands a second time within three words.
AGAIN = hashed_to("<again>", WORDS)


def shape_of(token: str) -> str | None:
    """How a token is written: capitals, a number, a run of signs (or letters and signs), or nothing of note."""
    if token.isalpha():
        return "<upper>" if token.isupper() and len(token) > 1 else None
    return "<number>" if token.isdigit() else "<sign " + (token if len(token) < 4 else token[:3] + "+") + ">"


class Tokens:
    """Tokens by number, with the row of each one's word and shape (-1: none, -2: none, but letters)."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.words, self.shapes = np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, tokens: list[str]) -> np.ndarray:
        found = list(map(self.number.get, tokens))
        if None in found:
            new = list(dict.fromkeys(t for t, n in zip(tokens, found) if n is None))
            if len(self.number) + len(new) > MEMORY:
                self.__init__()
                new = list(dict.fromkeys(tokens))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            shapes = [hashed_to(s, WORDS) if (s := shape_of(t)) else -2 for t in new]
            self.words = np.concatenate([self.words, np.fromiter(map(word_row, new), np.int64, len(new))])
            self.shapes = np.concatenate([self.shapes, np.array(shapes, np.int64)])
            found = list(map(self.number.__getitem__, tokens))
        return np.array(found, np.int64)


_TOKENS = Tokens()


def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of the texts, one text after another: the row of the word, that of the shape (or less than 0), the text's number."""
    per_text = [TOKEN.findall(t or "") for t in texts]
    at = _TOKENS([t for own in per_text for t in own])
    text = np.repeat(np.arange(len(texts)), [len(own) for own in per_text])
    shape = _TOKENS.shapes[at]
    again = np.zeros(len(at), bool)
    for d in (1, 2):
        again[d:] |= (at[d:] == at[:-d]) & (text[d:] == text[:-d])
    return _TOKENS.words[at], np.where(again & (shape == -2), AGAIN, shape), text


def portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts, whole, in portions of a bounded number of characters (or one text)."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t or "") > 4 * AT_ONCE:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t or "")
    if held:
        yield held


def add_neighbours(near: np.ndarray, words: np.ndarray, text: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
    """Add to each row of ``near`` (flat) the index vectors of its neighbours on both sides, within a text."""
    same = text[1:] == text[:-1]
    left, right = words[:-1][same], words[1:][same]
    for a, b in ((left, right), (right, left)):
        for j in range(ONES):
            near += np.bincount(a * WIDTH + place[b, j], weights=sign[b, j], minlength=len(near))


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The context vectors of all rows, from every document; each task adds up its own part first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (place, sign), near, held, n = index_places(), np.zeros(WORDS * WIDTH), [], 0

        def add() -> None:
            nonlocal held, n
            if held:
                number = np.repeat(np.arange(len(held)), [len(w) for w, _ in held])
                add_neighbours(near, np.concatenate([w for w, _ in held]), number * (1 << 32) + np.concatenate([t for _, t in held]), place, sign)
            held, n = [], 0

        for batch in batches:
            for part in portions(batch.column(0).to_pylist()):
                words, _, text = read(part)
                held.append((words, text))
                n += len(words)
                if n > 4 * AT_ONCE:
                    add()
        add()
        rows = near.reshape(WORDS, WIDTH).astype(np.float32)
        live = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(live // LANE, pa.int64()), pa.array(live, pa.int64()), pa.array([rows[r].tobytes() for r in live], pa.binary())], ["lane", "row", "v"])

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((WORDS, WIDTH))
        for frame in frames:
            np.add.at(total, frame["row"].to_numpy(), np.frombuffer(b"".join(frame["v"]), np.float32).reshape(-1, WIDTH))
        for lane in np.unique(np.flatnonzero(total.any(axis=1)) // LANE).tolist():
            yield pd.DataFrame({"lane": [lane], "v": [total[lane * LANE : (lane + 1) * LANE].astype(np.float32).tobytes()]})

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "lane long, row long, v binary")
    out = np.zeros((WORDS, WIDTH), np.float32)
    for r in parts.repartition("lane").mapInPandas(add_up, "lane long, v binary").collect():  # 4 MB in all
        out[r["lane"] * LANE : (r["lane"] + 1) * LANE] = np.frombuffer(bytes(r["v"]), np.float32).reshape(-1, WIDTH)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str | None], index: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A row for each text: mean context and index vector of its words, the vectors of the shapes (by the root of their share), and three lengths."""
    words, shape, text = read(texts)
    count = np.bincount(text, minlength=len(texts))
    n = np.maximum(count, 1)[:, None]
    out = np.zeros((len(texts), POOLED), np.float32)

    def sums(key: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        total = np.zeros((len(texts), vectors.shape[1]), np.float32)
        if len(key):
            own = key // WORDS
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[start]] = np.add.reduceat(weight[:, None] * vectors[key % WORDS], start, axis=0)
        return total

    key, times = np.unique(text * WORDS + words, return_counts=True)
    out[:, : 2 * WIDTH] = sums(key, times.astype(np.float32), np.concatenate([context, index], axis=1)) / n
    out[:, -2] = np.bincount(key // WORDS, minlength=len(texts)) / n[:, 0]
    marked = shape >= 0
    key, times = np.unique(text[marked] * WORDS + shape[marked], return_counts=True)
    out[:, 2 * WIDTH : 3 * WIDTH] = sums(key, np.sqrt(times / n[key // WORDS, 0]).astype(np.float32), index)
    out[:, -3] = np.log1p(count) / 5
    out[:, -1] = np.log1p([len(t or "") for t in texts]) / 8
    return out


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 50) -> dict[str, np.ndarray]:
    """Two layers by Adam on nine tenths of the rows; the temperature by a search on the rest."""
    if not len(x):
        return {"m": np.zeros(POOLED), "s": np.ones(POOLED), "a": np.zeros((POOLED, HIDDEN)), "b": np.zeros(HIDDEN), "c": np.zeros(HIDDEN), "d": np.zeros(1), "t": np.ones(1)}
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    left = np.arange(len(z)) % 10 == 9
    p = {"a": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    zt, yt = z[~left] if (~left).any() else z, y[~left] if (~left).any() else y
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(zt)), max(1, len(zt) // 256)):
            h = np.tanh(zt[part] @ p["a"] + p["b"])
            g = (sigmoid(h @ p["c"] + p["d"]) - yt[part]) / len(part)
            gh = np.outer(g, p["c"]) * (1 - h * h)
            grads = {"a": zt[part].T @ gh + 1e-3 * p["a"], "b": gh.sum(axis=0), "c": h.T @ g + 1e-3 * p["c"], "d": np.array([g.sum()])}
            step += 1
            for k, v in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                p[k] = p[k] - 4e-3 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    zl, yl = (z[left], y[left]) if left.any() else (z, y)
    logit = np.tanh(zl @ p["a"] + p["b"]) @ p["c"] + p["d"]

    def loss(t: float) -> float:
        q = np.clip(sigmoid(logit / t), 1e-9, 1 - 1e-9)
        return float(-(yl * np.log(q) + (1 - yl) * np.log(1 - q)).mean())

    return {**p, "m": mean, "s": scale, "t": np.array([min(np.geomspace(0.3, 5, 60), key=loss)])}


_ORDER = ("m", "s", "a", "b", "c", "d", "t")


def flatten(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(net[k]) for k in _ORDER])


def unflatten(flat: np.ndarray) -> dict[str, np.ndarray]:
    d = POOLED
    shapes, out, at = {"m": (d,), "s": (d,), "a": (d, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN,), "d": (1,), "t": (1,)}, {}, 0
    for k in _ORDER:
        n = int(np.prod(shapes[k]))
        out[k], at = flat[at : at + n].reshape(shapes[k]).astype(np.float64), at + n
    return out


def score(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    h = np.tanh((x - net["m"]) / net["s"] @ net["a"] + net["b"])
    return sigmoid((h @ net["c"] + net["d"]) / net["t"])


def held_out() -> F.Column:
    """Documents whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def with_quality(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs``, ``score`` (0 to 1, high: good) and ``predicted``.

    Word vectors are summed over all of ``docs``; the network learns from at most ``SAMPLE``
    documents of ``known`` (default: ``docs``) with a label, those held out excepted; see
    ``sampled_labels`` for repeated ids. Null texts count as empty and get a score too; every row is
    kept, repeated or not. Columns of ``docs`` that are named like a new one give way to it. Without
    labels every score is one half; an empty table gives no rows.
    """
    spark = docs.sparkSession
    context = context_sums(docs)
    vectors = spark.sparkContext.broadcast(context)  # 4 MB

    def of_texts(texts: list[str | None]) -> list[np.ndarray]:
        index = index_vectors()
        return [x for part in portions(texts) for x in pooled(part, index, vectors.value)]

    def fit(x: list[bytes], y: np.ndarray) -> np.ndarray:
        return flatten(fit_network(np.frombuffer(b"".join(x), np.float32).reshape(-1, POOLED).astype(np.float64), y))

    sample = sampled_labels(docs if known is None else known, labels, SAMPLE, "quality", ~held_out())
    net = spark.sparkContext.broadcast(unflatten(fitted(with_features(sample, of_texts), fit)))

    def scored(texts: list[str | None]) -> list[pa.Array]:
        index = index_vectors()
        p = np.concatenate([np.empty(0), *[score(pooled(part, index, vectors.value).astype(np.float64), net.value) for part in portions(texts)]])
        return [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]

    return with_columns(docs, {"score": "double", "predicted": "int"}, scored)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
