"""Writes and reads of the ledgers: idempotent stores, suppression, pairing, running offsets, tails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the new value counts unless it is null."""
    rest = [c for c in old.columns if c not in key]
    both = old.join(new.select(*key, *[F.col(c).alias(f"_{c}") for c in rest]), key, "full")
    return both.select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in rest])


def added(old: DataFrame, new: DataFrame, key: list[str], sums: list[str], flags: list[str] = ()) -> DataFrame:
    """Additive write: measures add up, flags stay once set."""
    return old.unionByName(new).groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in flags])


def first_wins(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(version))).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")


def superseded(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """The new row of a key only where its digest differs from the stored one; keys of one side stay."""
    known = old.select(*key, F.col(digest).alias("_old"))
    changed = new.join(known, key, "left").where(~F.col(digest).eqNullSafe(F.col("_old"))).drop("_old")
    return old.join(changed.select(*key), key, "left_anti").unionByName(changed)


def suppress_identical(rows: DataFrame, content: str, id_col: str) -> DataFrame:
    """``suppressed``: another row with the same content and a smaller id stands. Compared by digest, no text is sorted."""
    digest = F.sha2(content, 256)
    least = rows.groupBy(digest.alias("_h")).agg(F.min(id_col).alias("_first"))
    return rows.withColumn("_h", digest).join(least, "_h").withColumn("suppressed", F.col(id_col) != F.col("_first")).drop("_h", "_first")


def bare_copies(rows: DataFrame, content: str, owner: str, stands: Column) -> DataFrame:
    """Rows that do not stand themselves while an equal text of several owners has one that does."""
    marked = rows.withColumn("_h", F.sha2(content, 256)).withColumn("_s", stands)
    groups = marked.groupBy("_h").agg(F.count_distinct(owner).alias("_o"), F.bool_or("_s").alias("_any")).where("_o > 1 and _any").select("_h")
    return marked.where(~F.col("_s")).join(groups, "_h", "left_semi").drop("_h", "_s")


def paired(a: DataFrame, b: DataFrame, key: list[str], order: str) -> DataFrame:
    """Both sides in order within a key, set side by side; what has no partner stands alone."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    x = a.select(*key, F.col(order).alias("first_id"), nth.alias("_n"))
    y = b.select(*key, F.col(order).alias("second_id"), nth.alias("_n"))
    outcome = F.when(F.col("second_id").isNull(), "first only").when(F.col("first_id").isNull(), "second only").otherwise("both")
    return x.join(y, [*key, "_n"], "full").withColumn("outcome", outcome).drop("_n")


def reanchored(old: DataFrame, new: DataFrame, doc: str, text: str, place: str) -> DataFrame:
    """``anchor`` of each old citation: the same text, else the same place, else retired."""
    by_text = new.groupBy(doc, F.sha2(text, 256).alias("_h")).agg(F.min(place).alias("_to"))
    by_place = new.select(doc, place).distinct().withColumn("_at", F.lit(True))
    found = old.withColumn("_h", F.sha2(text, 256)).join(by_text, [doc, "_h"], "left").join(by_place, [doc, place], "left")
    return found.withColumn("anchor", F.when(F.col("_to").isNotNull(), "text").when(F.col("_at"), "place").otherwise("retired")).drop("_h", "_at")


def with_offsets(sections: DataFrame, doc: str, ordinal: str, text: str, gap: int = 2) -> DataFrame:
    """``char_start`` and ``char_end`` of each section in its document's text (code points)."""
    before = Window.partitionBy(doc).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length(text) + gap).over(before), F.lit(0))
    return sections.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.char_length(text))


def top(rows: DataFrame, by: str, id_col: str, k: int) -> DataFrame:
    """The ``k`` greatest by a column, ties to the smaller id, with their rank."""
    best = rows.orderBy(F.desc(by), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), id_col)))


def appended(lists: list[DataFrame], id_col: str) -> DataFrame:
    """Ranked lists one after another, every item where it first stands."""
    every = reduce(DataFrame.unionByName, [x.select(id_col, F.lit(i).alias("_list"), "rank") for i, x in enumerate(lists)])
    once = every.groupBy(id_col).agg(F.min(F.struct("_list", "rank")).alias("_k"))
    return once.select(id_col, F.row_number().over(Window.orderBy("_k")).alias("pos"))


def interleaved(lists: list[DataFrame], id_col: str) -> DataFrame:
    """Ranked lists by turns, every item where it first stands."""
    every = reduce(DataFrame.unionByName, [x.select(id_col, "rank", F.lit(i).alias("_list")) for i, x in enumerate(lists)])
    once = every.groupBy(id_col).agg(F.min(F.struct("rank", "_list")).alias("_k"))
    return once.select(id_col, F.row_number().over(Window.orderBy("_k")).alias("pos"))


def tail(events: DataFrame, cursor: str, after: int, page: int) -> DataFrame:
    """The next page of an append-only ledger behind a cursor."""
    return events.where(F.col(cursor) > after).orderBy(cursor).limit(page)
