"""Connected components by repeated contraction, on edges alone (no groups are collected)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: XOR masks that change the order of the vertices from round to round (fixed values).
ROUND_MASKS = (0x5DEECE66D1234567, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x6A09E667F3BCC908, 0x3C6EF372FE94F82B)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (vertex, root) for every vertex of ``edges``; roots are arbitrary members.

    Each round moves every vertex to the least vertex of its closed neighbourhood, under an order
    that is new in each round, so that about half of the vertices go however long the chains are.
    Minima are combined before the shuffle, and joins are on a side with one row a key, so a hub
    with a third of all edges is split by the adaptive skew join.
    Null endpoints and loops are ignored; no edges give no rows.
    """
    now = stored(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "cc-edges")
    moves = []
    while not now.isEmpty():
        mask = F.lit(ROUND_MASKS[len(moves) % len(ROUND_MASKS)])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.min(F.col("b").bitwiseXOR(mask)), F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask)
        move = stored(both.groupBy("a").agg(least.alias("to")), "cc-move")
        moves.append(move)
        to_a, to_b = move.select("a", F.col("to").alias("x")), move.select(F.col("a").alias("b"), F.col("to").alias("y"))
        now = stored(now.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    if not moves:
        return edges.select(F.col(a).cast("long").alias("vertex"), F.col(b).cast("long").alias("root")).where("false")
    found = moves[0].select(F.col("a").alias("vertex"), F.col("to").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("a").alias("root"), "to")
        found = found.join(step, "root", "left").select("vertex", F.coalesce("to", "root").alias("root"))
    return found
