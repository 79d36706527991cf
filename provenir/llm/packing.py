"""Best-fit packing of token sequences: a configuration linear program over the length histogram.

The histogram (one count for each length up to the capacity) is all that leaves the cluster, so the
program has the same size for any corpus, and so has its layout (about 7,000 rows, 0.35 MB, from a
hundred thousand to hundreds of millions of pieces). It is solved by multiplicative weights, each step priced
by a knapsack dynamic program, then rounded; what rounding leaves over is packed by the same dynamic
program, bin by bin. Every piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, parts
from .common import stored, table

CAPACITY = 2048
#: Steps of the multiplicative weights, and their size.
STEPS, RATE = 200, 0.25
#: Times that the program is solved again for what rounding has left.
ROUNDS = 6
#: Lengths that are tried first for each bin of what rounding has left.
SOME = 192


def best_bin(length: np.ndarray, count: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length fill one bin with the greatest value (bounded knapsack, exact)."""
    best = np.zeros(capacity + 1)
    taken, items = [], []
    for k in range(len(length)):
        left, times = min(int(count[k]), capacity // int(length[k])), 1
        while left > 0:
            n = min(times, left)
            size, worth = n * int(length[k]), n * value[k]
            with_it = best[: capacity + 1 - size] + worth
            better = with_it > best[size:]
            np.maximum(with_it, best[size:], out=best[size:])
            taken.append(better)
            items.append((k, n, size))
            left -= n
            times *= 2
    bin_, room = np.zeros(len(length), np.int64), int(np.argmax(best))
    for (k, n, size), better in zip(reversed(items), reversed(taken)):
        if room >= size and better[room - size]:
            bin_[k] += n
            room -= size
    return bin_


def _fractional(length: np.ndarray, need: np.ndarray, capacity: int, steps: int) -> tuple[list[tuple[np.ndarray, float]], np.ndarray, float]:
    """Multiplicative weights on the configuration program: (bin, times), the dual values, and the bound that these prove."""
    goal, live = np.maximum(need, 1).astype(float), need > 0
    share, chosen = np.zeros(len(length)), {}
    dual, bound = length / capacity, 0.0
    for _ in range(steps):
        weight = np.where(live, length * np.exp(np.clip(share[live].mean() - share, -6, 6)), 0.0)
        bin_ = best_bin(length, need, weight, capacity)
        if (proof := float(need @ weight) / float(bin_ @ weight)) > bound:
            dual, bound = weight / float(bin_ @ weight), proof
        held = bin_ > 0
        times = RATE * float(np.min(goal[held] / bin_[held]))
        chosen.setdefault(bin_.tobytes(), [bin_, 0.0])[1] += times
        share += times * bin_ / goal
    scale = 1 / max(float(np.average(share[live], weights=need[live] * length[live])), 1e-9)
    return [(bin_, times * min(scale, 1.0)) for bin_, times in chosen.values()], dual, bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: how many in one bin})] that packs the histogram exactly.

    ``histogram`` has lengths from 1 to ``capacity``; an empty one gives an empty plan.
    """
    length = np.array(sorted((k for k, n in histogram.items() if n > 0), reverse=True), np.int64)
    need = np.array([histogram[int(k)] for k in length], np.int64)
    out: list[tuple[int, dict[int, int]]] = []

    def use(bin_: np.ndarray, times: int) -> None:
        nonlocal need
        out.append((times, {int(length[k]): int(bin_[k]) for k in np.flatnonzero(bin_)}))
        need = need - times * bin_

    if not len(length):
        return out
    full = np.flatnonzero(length == capacity)
    if len(full):
        one = np.zeros(len(length), np.int64)
        one[full[0]] = 1
        use(one, int(need[full[0]]))
    worth = length + 1e-3 * length * length / capacity  # full bins first, and of equal ones that with the longer pieces
    for _ in range(ROUNDS):
        if need.sum() <= 4 * np.count_nonzero(need):  # too thin to round: the last part packs it
            break
        bins, dual, bound = _fractional(length, need, capacity, steps)
        if bound > 1.002 * (need @ length) / capacity:  # the volume is not what binds, so neither is it what a bin is worth
            worth = dual
        before = need.sum()
        for bin_, times in sorted(bins, key=lambda x: -float(x[0] @ worth)):
            held = bin_ > 0
            n = int(min(times, np.min(need[held] // bin_[held])))
            if n > 0:
                use(bin_, n)
        if need.sum() > 0.8 * before:
            break
    turn = 0
    while need.any():
        left = np.flatnonzero(need)
        turn += 1
        some = left[np.unique(np.r_[0, (turn + np.arange(SOME) * len(left) // SOME) % len(left)])] if len(left) > 2 * SOME else left
        bin_ = np.zeros(len(length), np.int64)
        bin_[some] = best_bin(length[some], need[some], worth[some], capacity)
        if bin_ @ length < capacity and len(some) < len(left):  # only all lengths together may fill it
            bin_[left] = best_bin(length[left], need[left], worth[left], capacity)
        held = bin_ > 0
        use(bin_, int(np.min(need[held] // bin_[held])))
    return out


def _layout(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, copies in a sequence, offset of the first copy), sorted by length and rank."""
    rows, next_rank, sequence = [], {}, 0
    for times, content in bins:
        at = 0
        for length, n in content.items():
            rank = next_rank.get(length, 0)
            rows.append((length, rank, times * n, sequence, n, at))
            next_rank[length] = rank + times * n
            at += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): every document as pieces of at most ``capacity`` ids.

    A document is its ids and then ``end_id``. Longer ones are cut so that all pieces but the first
    are full. ``nth`` counts the pieces of one length within a partition ``part``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = codec(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part_of in parts(batch):
                rows: list[list] = [[] for _ in range(6)]
                for i, ids in zip(part_of.column(0).to_pylist(), own.encode_all(part_of.column(1))):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    start = 0
                    for k in range((n + capacity - 1) // capacity):
                        length = first if k == 0 else capacity
                        for c, v in zip(rows, (i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length])):
                            c.append(v)
                        seen[length] += 1
                        start += length
                arrays = [pa.array(c, t) for c, t in zip(rows, (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
                arrays.insert(5, pa.array([part] * len(rows[0]), pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    Null texts count as empty: they are one piece, the end id alone. Repeated rows are packed each
    for itself, ids may repeat or be null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, capacity, id_col=id_col, text_col=text_col), "pieces")
    per_part = stored(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # one row for each length at most
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = spark.sparkContext.broadcast(_layout(plan(histogram, capacity)))
    # a row for each length and part; Spark broadcasts it only below its own threshold, else both sides are shuffled
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = layout.value
        key = rows[:, 0] << 44 | rows[:, 1] if len(rows) else np.empty(0, np.int64)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = rows[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 3] + nth // row[:, 4]
            offset = row[:, 5] + nth % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 2048 tokens; see ``packed``."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
