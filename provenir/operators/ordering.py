"""Places in a total order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.events import shared_folder


def positions(rows: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """``rows`` with their place (from 1) in ``order``: ranges are sorted side by side, then each range's start is added.

    The sorted ranges are written once to the shared folder, so that ranges and counts are of one layout.
    """
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = shared_folder(rows.sparkSession)
    laid.write.parquet(path)
    kept = rows.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return kept.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_start")


def nearest_partners(rows: DataFrame, within: str, kind: str, size: str, id_col: str = "doc_id") -> DataFrame:
    """(id, partner) for every row that has one: of the rows of its group those of another kind go first, then the nearest in size, then the smaller id.

    Rows of one group and size are counted together first, so what is sorted within a group is no
    longer than its list of different sizes, however many rows the group has.
    """
    d = rows.select(F.col(within).alias("g"), F.col(kind).alias("k"), F.col(size).alias("n"), F.col(id_col).alias("id"))
    per_kind = d.groupBy("g", "n", "k").agg(F.min("id").alias("first"))
    two = F.slice(F.array_sort(F.collect_list(F.struct("first", "k"))), 1, 2)  # a list of kinds
    sizes = per_kind.groupBy("g", "n").agg(two.alias("two")).select("g", "n", F.col("two")[0]["first"].alias("a"), F.col("two")[0]["k"].alias("ka"), F.get("two", F.lit(1))["first"].alias("b"))
    ids = d.groupBy("g", "n").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"))
    second = d.join(ids.where("rows > 1"), ["g", "n"]).where("id > low").groupBy("g", "n").agg(F.min("id").alias("next"))
    sizes = sizes.join(second, ["g", "n"], "left")
    mono = F.when(F.col("b").isNull(), F.col("ka"))  # the only kind of this size
    here = F.struct("n", "a", "ka", "b", mono.alias("mono"))

    def before(w: Window) -> tuple[Column, Column]:
        """The row before, and the nearest one before it that differs in its only kind."""
        p = F.lag(here).over(w)
        changed = F.when(p.isNotNull() & (p["mono"].isNull() | ~p["mono"].eqNullSafe(mono)), p)
        return p, F.last(changed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    up, down = Window.partitionBy("g").orderBy("n"), Window.partitionBy("g").orderBy(F.desc("n"))
    sides = sizes.select("g", "n", "a", "ka", "b", "next", *[x.alias(c) for w, names in ((up, ("lo", "lo_run")), (down, ("hi", "hi_run"))) for x, c in zip(before(w), names)])
    runs = sides.select("*", *[F.lag(c).over(w).alias(f"{c}2") for w, c in ((up, "lo_run"), (down, "hi_run"))])
    kinds = per_kind.groupBy("g").agg((F.min("k") != F.max("k")).alias("mixed"))
    own = d.join(runs.join(kinds, "g"), ["g", "n"])

    def other(x: Column) -> Column:
        """(distance, id) of the first row of another kind at a size."""
        found = F.when(x["ka"] != F.col("k"), x["a"]).otherwise(x["b"])
        return F.when(found.isNotNull(), F.struct(F.abs(x["n"] - F.col("n")).alias("far"), found.alias("id")))

    def same(x: Column) -> Column:
        return F.when(x.isNotNull(), F.struct(F.abs(x["n"] - F.col("n")).alias("far"), x["a"].alias("id")))

    at = F.when(F.col("ka") != F.col("k"), F.col("a")).otherwise(F.col("b"))
    there = F.when(at.isNotNull(), F.struct(F.abs(F.col("n") - F.col("n")).alias("far"), at.alias("id")))
    alike = F.when(F.col("a") != F.col("id"), F.col("a")).otherwise(F.col("next"))
    twin = F.when(alike.isNotNull(), F.struct(F.abs(F.col("n") - F.col("n")).alias("far"), alike.alias("id")))
    best = F.when(F.col("mixed"), F.least(there, *[F.coalesce(other(F.col(c)), other(F.col(f"{c}_run2"))) for c in ("lo", "hi")])).otherwise(F.least(twin, same(F.col("lo")), same(F.col("hi"))))
    return own.select(F.col("id").alias(id_col), best["id"].alias("partner")).where("partner is not null")
