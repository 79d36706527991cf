"""Lexical, dense and fused retrieval: BM25 over substrings, cosine scans, reciprocal-rank fusion, seats and caps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constant of reciprocal-rank fusion, and BM25's k1, b, floor of the inverse document frequency (fixed values).
RRF_K, K1, B, IDF_FLOOR = 60, 1.2, 0.75, 1e-6
#: Depths of a search, and the numbers of seats and of hits a source may have (fixed values).
DEPTH, PER_QUERY, PER_SOURCE, SEATS, GOVERNING, GOVERNING_EACH = 24, 40, 6, 2, 6, 6


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` stands in ``text``, ignoring case, without overlap."""
    low = F.lower(text)
    return ((F.char_length(low) - F.char_length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("long")


def grams(*columns: Column) -> Column:
    """The number of trigrams of some columns together."""
    return sum((F.greatest(F.char_length(c) - 2, F.lit(0)) for c in columns), F.lit(0))


def bm25(docs: DataFrame, terms: list[str], text: str = "text", heading: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every document that holds a term, headings counting half; statistics are those of all ``docs``.

    One pass finds the counts of all terms, one aggregate of a single row the statistics; no term is
    joined to the documents.
    """
    head = F.coalesce(F.col(heading), F.lit("")) if heading else F.lit("")
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(F.col(id_col), grams(body, head).alias("_d"), *[(occurrences(body, t) + 0.5 * occurrences(head, t)).alias(f"_f{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_d").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(terms))])
    both = counted.join(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
        f = F.col(f"_f{i}")
        total = total + F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_d") / F.col("_avg")))
    some = " or ".join(f"_f{i} > 0" for i in range(len(terms)))
    return both.where(some).select(id_col, total.alias("score"))


def postings(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """(gram, id, tf): the inverted index of lower-case character grams, for corpora that are searched often.

    Texts are dealt by id before they are cut, so that each text is shuffled once and its grams, of
    which there are as many as characters, are counted where they are made.
    """
    chars = docs.repartition(id_col).select(id_col, F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "").alias("c")).where(F.size("c") >= width)
    every = F.transform(F.sequence(F.lit(0), F.size("c") - width), lambda i: F.concat(*[F.get("c", i + k) for k in range(width)]))
    return chars.select(id_col, F.explode(every).alias("gram")).groupBy("gram", id_col).agg(F.count(F.lit(1)).alias("tf"))


def inner(v: Column, query: list[float]) -> Column:
    """The inner product with a fixed vector, in doubles."""
    return F.aggregate(F.zip_with(v.cast("array<double>"), F.array(*[F.lit(float(x)) for x in query]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def checked_vectors(vectors: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """``vectors``, which fails loudly at a vector of another length or with a component that is no number."""
    bad = (F.size(vector) != dims) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.withColumn(vector, F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a damaged vector in the index"))).otherwise(F.col(vector)))


def ranked(hits: DataFrame, by: list[str], score: str = "score", id_col: str = "doc_id", k: int | None = None, digits: int = 6) -> DataFrame:
    """``rank`` within each run (``by``): best score first, ties to the smaller id."""
    rounded = hits.withColumn(score, F.round(score, digits))
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    out = rounded.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def fused(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion of runs: (id, score, channels)."""
    return runs.groupBy(id_col).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 8).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


def eligible_fusion(runs: DataFrame, eligibility: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fusion divided by the number of runs that could have returned the item (``eligibility``: id, n_runs)."""
    return fused(runs, id_col).join(eligibility, id_col).withColumn("score", F.round(F.col("score") / F.col("n_runs"), 8))


def capped(hits: DataFrame, group: str, cap: int = PER_SOURCE, position: str = "pos", id_col: str = "doc_id") -> DataFrame:
    """Beyond ``cap`` of a group items move behind all others; none is dropped. Gives a new position."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(position, id_col))
    shifted = hits.withColumn("_over", (nth > cap).cast("int"))
    return shifted.withColumn(position, F.row_number().over(Window.orderBy("_over", position, id_col))).drop("_over")


def seated(runs: DataFrame, merged: DataFrame, seats: int = SEATS, id_col: str = "doc_id") -> DataFrame:
    """Every run's best first, round by round, each item once; then the merged order. ``runs`` has run_no and rank."""
    first = runs.where(F.col("rank") <= seats).groupBy(id_col).agg(F.min(F.struct("rank", "run_no")).alias("_seat"))
    both = merged.join(first, id_col, "left")
    order = Window.orderBy(F.col("_seat").isNull(), F.col("_seat.rank"), F.col("_seat.run_no"), F.desc("score"), id_col)
    return both.withColumn("pos", F.row_number().over(order)).drop("_seat")


def governing_seats(ordered: DataFrame, governing: DataFrame, best_rank: DataFrame, depth: int = DEPTH, each: int = GOVERNING_EACH, group: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The first ``depth`` items, then up to ``each`` items not yet held of every governing group."""
    held = ordered.where(F.col("pos") <= depth)
    rest = ordered.where(F.col("pos") > depth).join(F.broadcast(governing.select(group)), group, "left_semi").join(best_rank, id_col, "left")
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.col("best_rank").asc_nulls_last(), "pos", id_col))
    more = rest.withColumn("_n", nth).where(F.col("_n") <= each).drop("_n", "best_rank")
    return held.withColumn("seat", F.lit("depth")).unionByName(more.withColumn("seat", F.lit("governing")))


def adaptive_depth(n: Column, base: int) -> Column:
    """A depth that grows with the square root of the corpus, from one to two times the base."""
    return F.round(base * F.least(F.lit(2.0), F.greatest(F.lit(1.0), F.sqrt(n / 19000.0)))).cast("int")


def idf_plus(n: Column, df: Column) -> Column:
    """ln(1 + N/df), 0 where no title has the word."""
    return F.when(df > 0, F.log(1 + n / df)).otherwise(0.0)


def sibling_idf(n: int, df: int) -> float:
    """ln(N/df) among the rules of one parent."""
    return math.log(n / df) if df else 0.0
