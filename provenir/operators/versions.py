"""Two runs over the same provisions, paired row by row in three passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain(c: Column) -> Column:
    """White space single, ends trimmed, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")))


def compared(a: DataFrame, b: DataFrame, key: list[str], order: str, indicator: str = "indicator", quote: str = "quote", citation: str = "url", names: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Every row of both runs, paired closest first within a provision (``key``), with what differs.

    Rows are paired first by indicator and quote, then what is left by indicator, then what is left
    of that; each time in order, one to one. A row without a partner stands alone. Every pass looks
    at the residue of the one before: a row is paired if its place in its group is within the
    number of rows that the other run has left there, so no pass joins the runs. Null keys are a
    provision like others. Returns the key, both ids (``order``), the pass, found_by and flags.
    """
    side = lambda df, s: df.select(*key, F.col(order).alias("_id"), F.col(indicator).cast("string").alias("_indicator"), plain(F.col(indicator)).alias("_i"), plain(F.col(quote)).alias("_q"), plain(F.col(citation)).alias("_c"), F.lit(s).alias("_side"))
    rows = side(a, 0).unionByName(side(b, 1)).withColumn("_pass", F.lit(None).cast("int")).withColumn("_nth", F.lit(None).cast("int"))
    groups = ([*key, "_i", "_q"], [*key, "_i"], key)
    for k, by in enumerate(groups, 1):
        free = F.col("_pass").isNull()
        # rows that are paired already stand in partitions of their own
        nth = F.row_number().over(Window.partitionBy(*by, "_side", free).orderBy("_id"))
        left = [F.count_if(F.col("_side") == s).over(Window.partitionBy(*by, free)) for s in (0, 1)]
        rows = rows.withColumns({"_n": nth, "_least": F.least(*left)})
        meets = free & (F.col("_n") <= F.col("_least"))
        rows = rows.withColumns({"_nth": F.when(meets, F.col("_n")).otherwise(F.col("_nth")), "_pass": F.when(meets, F.lit(k)).otherwise(F.col("_pass"))}).drop("_n", "_least")
    alone = F.col("_pass").isNull()
    pair = F.struct(
        F.coalesce("_pass", F.lit(0)).alias("pass"),
        F.when(F.col("_pass") <= 2, F.col("_i")).alias("i"),
        F.when(F.col("_pass") == 1, F.col("_q")).alias("q"),
        F.coalesce("_nth", F.lit(0)).alias("nth"),
        F.when(alone, F.struct("_side", "_id")).alias("own"),
    )
    fields = F.struct("_id", "_indicator", "_i", "_q", "_c")
    both = rows.groupBy(*key, pair.alias("_pair")).agg(*[F.max(F.when(F.col("_side") == s, fields)).alias(c) for s, c in ((0, "_a"), (1, "_b"))])
    found = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    flags = {f"{name}_differs": F.coalesce(found & (F.col(f"_a.{c}") != F.col(f"_b.{c}")), F.lit(False)) for name, c in (("indicator", "_i"), ("citation", "_c"), ("quote", "_q"))}
    how = F.concat_ws(
        "; ",
        F.when(flags["indicator_differs"], F.concat(F.lit(f"{names[0]} mapped it to "), F.coalesce("_a._indicator", F.lit("none")), F.lit(f", {names[1]} to "), F.coalesce("_b._indicator", F.lit("none")))),
        F.when(flags["citation_differs"], "the two cited different links to the same provision"),
        F.when(flags["quote_differs"], "the two copied different words out of it"),
    )
    return both.select(
        *key,
        F.col("_a._id").alias("first_id"),
        F.col("_b._id").alias("second_id"),
        F.col("_pair.pass").alias("pass"),
        F.when(found, "both").when(F.col("_b").isNull(), names[0]).otherwise(names[1]).alias("found_by"),
        *[f.alias(name) for name, f in flags.items()],
        F.when(F.col("_b").isNull(), f"{names[1]} did not produce this provision").when(F.col("_a").isNull(), f"{names[0]} did not produce this provision").when(how == "", "identical").otherwise(how).alias("how_they_differ"),
    )
