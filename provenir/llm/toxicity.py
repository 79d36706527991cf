"""Toxicity by classifier chains: categories in a fixed order, each a linear model that also sees
the probabilities of the categories before it. While fitting, these come from models that have not
seen the row (out-of-fold), so that later models learn how far the earlier ones can be trusted.

The labelled table has one mark, toxic or not. The categories before it in the chain are kinds of
abuse that the labelled documents themselves show: the terms that mark toxic documents are grouped
by the documents they occur in, and a document belongs to a kind if it is marked and holds a term of
that group. No list of words is given, so any language and script with labels has its kinds. The
last category is the mark itself, whatever its cause.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textmodel import Hasher, Rows, fit_linear, fitted, off_expectation, sampled_labels, scores, sigmoid, with_columns, with_features

#: Kinds of abuse that are told apart, before the mark itself.
KINDS = 3
CHAIN = (*(f"kind{k + 1}" for k in range(KINDS)), "toxic")
#: At most so many labelled documents are learnt from.
SAMPLE = 8000
FEATURES, FOLDS, PREFIX = 1 << 18, 4, 5
#: Features that reach the fit: the clearest ones of the sample, by deviations from their share.
LIVE, CLEAR = 1 << 14, 2.0
#: Terms that kinds are made of: so many deviations off, and at most so many.
MARKER, MARKERS = 6.0, 512
#: A document is toxic from this probability of the last category.
REJECT = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_SEEN = Hasher(FEATURES)


def features(text: str | None) -> np.ndarray:
    """Distinct hashed words and beginnings of words of the whole text."""
    found = set(_WORD.findall((text or "").lower()))
    starts = {"^" + w[:PREFIX] for w in found if len(w) > PREFIX}
    return np.unique(_SEEN([*found, *starts])) if found else np.empty(0, np.int64)


def kinds(rows: Rows, toxic: np.ndarray) -> np.ndarray:
    """Marks (rows x KINDS): the marker terms in KINDS groups by the toxic rows they stand in (spherical k-means).

    The first centre is the clearest marker, each further one that which is least like those before.
    """
    out = np.zeros((rows.n, KINDS))
    off = off_expectation(rows, toxic, FEATURES, np.ones(rows.n, bool))
    marker = np.argsort(-off, kind="stable")[:MARKERS]
    marker = marker[off[marker] >= MARKER]
    if not len(marker):
        return out
    place = np.full(FEATURES, -1)
    place[marker] = np.arange(len(marker))
    held = (place[rows.at] >= 0) & (toxic[rows.row] > 0)
    x = np.zeros((len(marker), rows.n), np.float32)
    x[place[rows.at[held]], rows.row[held]] = 1
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = unit[:1]
    while len(centre) < min(KINDS, len(marker)):
        centre = np.concatenate([centre, unit[[int((unit @ centre.T).max(axis=1).argmin())]]])
    for _ in range(12):
        group = (unit @ centre.T).argmax(axis=1)
        sums = np.array([unit[group == k].sum(axis=0) if (group == k).any() else centre[k] for k in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    for k in range(len(centre)):
        out[:, k] = x[group == k].max(axis=0, initial=0)
    return out


def fit_chain(found: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Weights of all links, one after another (float32; see ``split_weights``)."""
    rows = Rows(found)
    y = np.column_stack([kinds(rows, toxic), toxic]) if rows.n else np.zeros((0, len(CHAIN)))
    fold = np.arange(rows.n) % FOLDS
    before, out = np.zeros((rows.n, 0)), []
    for k in range(len(CHAIN)):
        apart = np.zeros(rows.n)
        if k + 1 < len(CHAIN):
            for f in range(FOLDS):
                w = fit_linear(rows, before, y[:, k], FEATURES, fold != f)
                apart[fold == f] = scores(rows, before, w, FEATURES)[fold == f]
        out.append(fit_linear(rows, before, y[:, k], FEATURES, np.ones(rows.n, bool)))
        before = np.column_stack([before, apart])
    return np.concatenate(out).astype(np.float32)


def split_weights(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for k in range(len(CHAIN)):
        out.append(flat[at : at + FEATURES + k + 1])
        at += FEATURES + k + 1
    return out


def predict(chain: list[np.ndarray], text: str | None) -> list[float]:
    at, before = features(text), []
    for w in chain:
        x = float(w[at].sum()) + sum(p * float(v) for p, v in zip(before, w[FEATURES:])) + float(w[-1])
        before.append(float(sigmoid(np.float64(x))))
    return before


def clear_features(sample: DataFrame) -> DataFrame:
    """``sample`` (doc_id, _mark, x) with the clearest features only, so that the fit's input is bounded."""
    each = sample.select("_mark", F.explode("x").alias("f"))
    share = sample.agg(F.coalesce(F.avg("_mark"), F.lit(0.0)).alias("p")).first()["p"]
    counts = each.groupBy("f").agg(F.sum("_mark").alias("inside"), (F.count(F.lit(1)) * F.lit(share)).alias("expected"))
    off = F.abs(F.col("inside") - F.col("expected")) / F.sqrt(F.col("expected") + 0.5)
    live = np.array(sorted(r["f"] for r in counts.where(off > CLEAR).orderBy(off.desc(), "f").limit(LIVE).select("f").collect()), np.int32)  # LIVE numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.intersect1d(np.asarray(v, np.int32), live, assume_unique=True).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.binary())], ["doc_id", "_mark", "x"])

    return sample.mapInArrow(run, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, _mark double, x binary")


def with_toxicity(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs``, the probability ``p_<category>`` of each link, and ``is_toxic``.

    Learns from ``known`` (default: ``docs``) where ``labels`` has a mark; see ``sampled_labels`` for
    repeated ids. Null and empty texts get the score of a text without words; every row is kept,
    repeated or not, and ties cannot arise. Columns of ``docs`` that are named like a new one give
    way to it. Without any labelled document all probabilities are one half and nothing counts as
    toxic; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sample = with_features(sampled_labels(docs if known is None else known, labels, SAMPLE, "toxic"), lambda texts: [features(t) for t in texts], "array<int>")
    flat = fitted(clear_features(sample), lambda x, y: fit_chain([np.frombuffer(v, np.int32) for v in x], y))
    chain = spark.sparkContext.broadcast(split_weights(flat))

    def probabilities(texts: list[str | None]) -> list[pa.Array]:
        own = chain.value
        p = np.array([predict(own, t) for t in texts], float).reshape(len(texts), len(CHAIN))
        return [*(pa.array(c) for c in p.T), pa.array(p[:, -1] > REJECT)]

    return with_columns(docs, {**{f"p_{c}": "double" for c in CHAIN}, "is_toxic": "boolean"}, probabilities)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the probability of each category and is_toxic for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    scored = with_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), docs)
    return scored.drop("text")
