"""Shards of near equal bytes: leaves of a k-d tree over the metadata of the documents.

A node is split at the byte-weighted median of its widest metadata dimension, until it has at most
the target bytes of a leaf or cannot be split. The medians of all nodes of a level are found
together, from histograms that get finer with each pass: a pass adds up bytes by node and bin
(combined before the shuffle), and only one number a node comes to the driver. The leaves, a bounded
number, are dealt to the shards, the largest first and each to the shard with the fewest bytes.
Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS = 16
#: A leaf's target: this part of a shard.
LEAVES = 4
#: A node within this of the target is a leaf (medians are as fine as the units allow).
SLACK = 1.2
#: Binary digits of a place on a dimension, and how many of them a pass tells apart.
DIGITS, PASS = 61, 13
#: A bin with less than this part of half a node need not be told apart further.
CLOSE = 0.01
#: A group with more than this part of all rows is placed by a broadcast row (at most so many).
HOT = 512
SALTS = 1024
#: Rows that get their slots in one sort.
RUN = 100_000


def _place(rank: Column, tie: Column) -> Column:
    """A long whose order is that of ``rank`` (0 to 1), ties in the order of ``tie`` (31 binary digits)."""
    return F.shiftleft(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), rank)) * ((1 << 30) - 1)).cast("long"), 31) + tie


def _by_node(values: dict[int, float]) -> Column:
    return F.create_map(*[F.lit(x) for n, v in values.items() for x in (n, v)])[F.col("node")]


def _medians(units: DataFrame, wholes: dict[int, float]) -> dict[int, int]:
    """For each node the place up to which nearest to half of its bytes lie (units: node, place, bytes)."""
    halves = {n: v / 2 for n, v in wholes.items()}
    low, below, shift = dict.fromkeys(halves, 0), dict.fromkeys(halves, 0), DIGITS
    while shift > 0:
        step = min(PASS, shift)
        shift -= step
        within = units.where(F.shiftright("place", shift + step) == F.shiftright(_by_node(low), shift + step))
        bins = within.groupBy("node", F.shiftright("place", shift).alias("bin")).agg(F.sum("bytes").alias("bytes"))
        run = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        reached = bins.withColumn("run", run + _by_node(below)).where(F.col("run") >= _by_node(halves))
        found = {r["node"]: r["x"] for r in reached.groupBy("node").agg(F.min(F.struct("bin", "run", "bytes")).alias("x")).collect()}  # a row a node
        for n, x in found.items():
            low[n], below[n] = x["bin"] << shift, x["run"] - x["bytes"]
        if all(x["bytes"] <= CLOSE * halves[n] for n, x in found.items()):
            break
    # the last bin goes to the side that it leaves nearer to the half, unless the other would be empty
    return {n: low[n] - 1 if below[n] > 0 and halves[n] - below[n] < below[n] + x["bytes"] - halves[n] else low[n] + (1 << shift) - 1 for n, x in found.items()}


def _dealt(leaves: dict[int, int], shards: int) -> dict[int, int]:
    """The shard of each leaf: largest first, each to the shard with the fewest bytes so far.

    Then the fullest shard gives a leaf away, or changes one for a smaller one, as long as that
    lowers the larger of the two shards concerned.
    """
    filled, held = [0] * shards, [[] for _ in range(shards)]

    def move(n: int, start: int | None, end: int) -> None:
        if start is not None:
            held[start].remove(n)
            filled[start] -= leaves[n]
        held[end].append(n)
        filled[end] += leaves[n]

    for n in sorted(leaves, key=lambda n: (-leaves[n], n)):
        move(n, None, min(range(shards), key=lambda s: (filled[s], s)))
    while True:
        full = max(range(shards), key=lambda s: (filled[s], s))
        steps = [(abs(filled[full] - filled[s] - 2 * d), filled[full] - filled[s], a, b, s) for s in range(shards) for a in held[full] for b in (None, *held[s]) if 0 < (d := leaves[a] - (leaves[b] if b else 0)) < filled[full] - filled[s]]
        best = max(steps, key=lambda x: (x[1] - x[0], -x[2]), default=None)
        if best is None:
            return {n: s for s, own in enumerate(held) for n in own}
        move(best[2], full, best[4])
        if best[3]:
            move(best[3], best[4], full)


def shards(docs: DataFrame, count: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): ``count`` shards of near equal bytes.

    Size: UTF-8 bytes of the text (null: none) plus 1. Dimensions: the size (its logarithm), the
    place of the smallest id, and each string of ``metadata`` that the table has (by its hash; null
    counts as a value). Equal texts go to one shard; only a group with more bytes than a shard's
    share cannot, and its rows are dealt singly. Slots are gapless from 0 in each shard. The law is
    ``bytes``, so ``grown_shard`` is null. Null ids, repeated rows and empty texts are rows like any
    other; other columns, whatever their names, are not carried; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [c for c in metadata if c in docs.columns]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        *[F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(1 << 20)).alias(f"m{i}") for i, c in enumerate(kept)],
    ).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS)))
    rows = stored(rows, "sizes")
    whole = rows.agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n")).first()
    if not whole["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    share = whole["bytes"] / count
    same = ["h", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # groups that fit no shard (fewer than ``count``) are split; those with a large part of all rows (at most HOT) are only placed apart
    known = groups.where((F.col("n") > 1) & ((F.col("bytes") > share) | (F.col("n") * HOT > whole["n"]) & (F.col("n") > RUN // HOT))).collect()
    split, hot = [r["h"] for r in known if r["bytes"] > share], [r["h"] for r in known]
    rows = rows.withColumn("salt", F.when(F.col("h").isin(split), F.col("salt")).otherwise(-1)) if split else rows.withColumn("salt", F.lit(-1).cast("long"))
    key = [*same, "salt"]
    units = rows.groupBy(*key).agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(len(kept))])
    tie = F.pmod(F.xxhash64(*key), F.lit((1 << 31) - 1))
    span = max(1, (whole["high"] or 0) - (whole["low"] or 0))
    ranks = [F.log(F.col("size").cast("double")) / F.log(F.lit(float(whole["most"]) + 1)), (F.coalesce("first", F.lit(whole["low"] or 0)) - (whole["low"] or 0)) / F.lit(float(span)), *[F.col(f"m{i}") / float(1 << 20) for i in range(len(kept))]]
    dims = [f"d{i}" for i in range(len(ranks))]
    units = stored(units.select(*key, "bytes", *[_place(r, tie).alias(d) for r, d in zip(ranks, dims)], F.lit(1).alias("node")), "units")
    leaves: dict[int, int] = {}
    while True:
        nodes = units.groupBy("node").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).collect()  # a row a node
        leaves = {r["node"]: r["bytes"] for r in nodes}
        open_ = [r for r in nodes if r["n"] > 1 and r["bytes"] > SLACK * share / LEAVES and any(r[d] for d in dims)]
        if not open_:
            break
        widest = {r["node"]: max(range(len(dims)), key=lambda i: (r[dims[i]], -i)) for r in open_}
        placed = units.withColumn("place", F.coalesce(*[F.when(F.col("node").isin([n for n, i in widest.items() if i == k]), F.col(d)) for k, d in enumerate(dims) if k in widest.values()]))
        cut = _medians(placed.where("place is not null").select("node", "place", "bytes"), {r["node"]: r["bytes"] for r in open_})
        side = F.when(F.col("place").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (F.col("place") > _by_node(cut)).cast("int"))
        units = stored(placed.withColumn("node", side).drop("place"), "units")
    of_leaf = _dealt(leaves, count)
    shard_of = units.select(*key, F.create_map(*[F.lit(x) for n, s in of_leaf.items() for x in (n, s)])[F.col("node")].alias("shard"))
    plain = rows.where(~F.col("h").isin(hot)) if hot else rows
    dealt = plain.select("doc_id", *key).join(shard_of, key)
    if hot:  # at most HOT keys, or SALTS for each of fewer than ``count``
        few = F.broadcast(shard_of.where(F.col("h").isin(hot)))
        dealt = dealt.unionByName(rows.where(F.col("h").isin(hot)).select("doc_id", *key).join(few, key))
    runs = max(1, whole["n"] // RUN)
    dealt = stored(dealt.withColumn("run", F.pmod(F.xxhash64("h", "doc_id", "salt", F.monotonically_increasing_id()), F.lit(runs))), "dealt")
    counts = dealt.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "run", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "h")) - 1
    return dealt.withColumn("nth", nth).join(before, ["shard", "run"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 15, law ``bytes``; see ``shards``."""
    return shards(table(spark, sf_dir, "documents"))
