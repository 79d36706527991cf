"""Periodic runs of words, found by probing a harmonic grid.

A run of period p is at least four periods long, so the places whose word returns p words later
cover three multiples of p at least. For each p only the words at jp and (j+1)p are compared (over
all p this is n ln n comparisons), three equal neighbours in the grid make a candidate, and
candidates are extended by comparing whole stretches of the array. Periods ascend, and grid points
deep within a run that is known already are skipped: no other run reaches them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A run has so many words and so many periods at least (the grid needs four periods).
LEAST, PERIODS = 6, 4
#: Words that are worked on together (a longer document is worked on alone).
SLAB = 1 << 19
#: Words that an extension compares at first and at most.
FIRST, MOST = 64, 1 << 16
#: Rounds of places between the points of a candidate that are compared before it is extended.
PROBES = 4
#: What stands between words (a fixed value; bytes.split() cuts at the same bytes).
WORD = r"[^\x20\x09-\x0D]+"


def _right(w: np.ndarray, at: int, p: int) -> int:
    """The first place from ``at`` on whose word does not return p words later."""
    step = FIRST
    while at + p < len(w):
        own = w[at : min(at + step, len(w) - p)]
        differs = own != w[at + p : at + p + len(own)]
        if differs.any():
            return at + int(differs.argmax())
        at, step = at + len(own), min(2 * step, MOST)
    return at


def _left(w: np.ndarray, at: int, p: int) -> int:
    """The least place from which on all words up to ``at`` return p words later."""
    step = FIRST
    while at > 0:
        own = w[max(0, at - step) : at]
        differs = own != w[at - len(own) + p : at + p]
        if differs.any():
            return at - int(differs[::-1].argmax())
        at, step = at - len(own), min(2 * step, MOST)
    return at


class _Known:
    """The runs found so far, of all periods below the present one."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = []
        self.array = np.empty((0, 3), np.int64)

    def skipped(self, base: int, p: int, n: int) -> np.ndarray | None:
        """For each of the n grid points base + jp: does it stand deep within a known run?

        A run of period p shares fewer than p + q words with a known run of period q, so it has no
        place to be compared from q words behind the start to 2p words before the end of that run.
        If q divides p, the places up to p words before the end are one stretch that returns p words
        later, and belong to the known run alone.
        """
        if len(self.array) != len(self.rows):
            self.array = np.array(self.rows, np.int64).reshape(-1, 3)
        start, length, q = self.array.T
        whole = p % q == 0
        first = -((base - start - np.where(whole, 0, q)) // p)  # rounded up
        last = (start + length - np.where(whole, p + 1, 2 * p) - base) // p
        own = (last >= first) & (last >= 0) & (first < n)
        if not own.any():
            return None
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, np.maximum(first[own], 0), 1)
        np.add.at(change, np.minimum(last[own], n - 1) + 1, -1)
        return np.cumsum(change[:n]) > 0


def _threes(equal: np.ndarray) -> np.ndarray:
    """Where three neighbours in the grid are equal."""
    return np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:])


def runs_of(w: np.ndarray, from_period: list[int], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array of word numbers.

    ``from_period[p - 1]`` is the place from which on runs of period p can stand; the array ends
    with a number that occurs once.
    """
    known = _Known()
    for p, base in enumerate(from_period, 1):
        grid = w[base::p]
        equal = grid[:-1] == grid[1:]
        at = _threes(equal)
        if not len(at):
            continue
        if known.rows and (deep := known.skipped(base, p, len(equal))) is not None:
            equal = equal & ~deep
            at = _threes(equal)
        places = base + at * p
        for k in range(1, PROBES + 1):  # all places up to the third point must return as well
            if len(places) and p > 1:
                between = places + (2 * p * k) // (PROBES + 1)
                places = places[w[between] == w[between + p]]
        done, found = -1, []
        for place in places.tolist():
            if place >= done:
                done = end = _right(w, place, p)
                if end > place + 2 * p:  # the three points are of one stretch
                    start = _left(w, place, p)
                    if end - start + p >= max(least, periods * p):
                        found.append((start, end - start + p, p))
        known.rows += found
    return known.rows


def _slab(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some documents, given as words; ordered by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    w = np.empty(starts[-1], np.int64)
    for k, i in enumerate(order):  # a number of its own behind each document keeps runs within it
        w[starts[k] : starts[k] + sizes[k]] = np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i]))
        w[starts[k] + sizes[k]] = -1 - k
    longest = int(sizes[-1]) // PERIODS if len(sizes) and sizes[-1] >= LEAST else 0
    needed = np.maximum(LEAST, PERIODS * np.arange(1, longest + 1))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, p in runs_of(w, starts[np.searchsorted(sizes, needed)].tolist()):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[order[k]].append((start - int(starts[k]), length, p))
    for own in out:
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stand in no run behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def with_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row.

    ``runs`` is an array of (start, length, period) in words, by start, then period: the stretches
    whose smallest period is ``period``, of six words and four periods at least, that neither
    neighbour extends. ``collapsed`` is the text with one blank between words and without the words
    that stand in a run behind its first period. Null and empty texts have no words and no runs;
    null and repeated ids and repeated rows are rows of their own; an empty table gives no rows.
    Texts are read whole, nothing is shuffled.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs = _slab(texts)
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            ends = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(run_type))
            lists = pa.ListArray.from_arrays(pa.array(ends), structs)
            texts_left = pa.array([b" ".join(_kept(t, own)) for t, own in zip(texts, runs)], pa.binary())
            return pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), lists, texts_left], ["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            at, words, texts = 0, 0, []
            for i in range(batch.num_rows):
                own = (batch.column(1)[i].as_py() or b"").split()
                if texts and words + len(own) > SLAB:
                    yield rows(batch.column(0).slice(at, i - at), texts)
                    at, words, texts = i, 0, []
                texts.append(own)
                words += len(own)
            if texts:
                yield rows(batch.column(0).slice(at), texts)

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, a tenth of which by the hash of the id end in repeated words (a fixed rule of the query's users).

    Of these, words from place a on are the first p of them again and again. Rows without id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(word, " ")).otherwise("")

    # the words of a text are bound once by the outer transform
    edited = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), repeated)[0]
    return docs.withColumn("text", F.when(h % 10 == 0, edited).otherwise(F.col("text")))


def _greatest_first(a: Column, b: Column) -> Column:
    """Order of runs by exact length / period (compared as products), greatest first; then by start and period."""
    x, y = a["length"] * b["period"], b["length"] * a["period"]
    less = F.when(x != y, x > y).when(a["start"] != b["start"], a["start"] < b["start"]).otherwise(a["period"] < b["period"])
    same = (x == y) & (a["start"] == b["start"]) & (a["period"] == b["period"])
    return F.when(same, 0).when(less, -1).otherwise(1)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents`` and what is left without repeats; see ``with_runs`` and ``with_repeats``."""
    found = with_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    found = found.withColumn("best", F.get(F.array_sort("runs", _greatest_first), F.lit(0)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
