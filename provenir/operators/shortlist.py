"""The register shortlist: owners ranked by titles and headings, by words and by vectors.

Four channels answer each question; their ranks are fused, divided by the number of runs that could
have found an owner, over-fetched three times before owners are looked up, and blended with a list
of one kind alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as R
from .indicator import written

#: Headings in an owner's vector, hits of a run, over-fetch before the look-up, share of the list for the primary kind, headings named (fixed values).
HEADINGS, PER_RUN, OVER, PRIMARY_SHARE, NAMED = 24, 40, 3, 0.5, 3
CHANNELS = ("title-lexical", "title-dense", "heading-lexical", "heading-dense")


def _scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def unit(v: Column) -> Column:
    """The vector at length one; null if it has none."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, _scaled(v, length))


def owner_vectors(titles: DataFrame, headings: DataFrame, owner: str = "owner", vector: str = "vector", ordinal: str = "ordinal", dims: int = 64) -> DataFrame:
    """(owner, vector): title and the first ``HEADINGS`` headings with a vector, averaged and brought to length one.

    Sums are made component by component in one aggregate, so no owner's vectors are gathered.
    Owners without any vector have none.
    """
    nth = F.row_number().over(Window.partitionBy(owner).orderBy(ordinal))
    top = headings.where(F.col(vector).isNotNull()).withColumn("_n", nth).where(F.col("_n") <= HEADINGS)
    every = titles.where(F.col(vector).isNotNull()).select(owner, F.col(vector).cast("array<double>").alias("_v")).unionByName(top.select(owner, F.col(vector).cast("array<double>").alias("_v")))
    sums = every.groupBy(owner).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col("_v")[i]).alias(f"_{i}") for i in range(dims)])
    return sums.select(owner, unit(_scaled(F.array(*[F.col(f"_{i}") for i in range(dims)]), F.col("_n"))).alias(vector)).where(F.col(vector).isNotNull())


def _weights(texts: DataFrame, terms: list[str], text: str, owner: str) -> tuple[DataFrame, list[str]]:
    """Each text with the weight of each term that it holds, ln(1 + N/df) over owners; a statistic of one row."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    held = texts.select("*", *[F.contains(low, F.lit(t)).alias(f"_t{i}") for i, t in enumerate(terms)])
    per_owner = held.groupBy(owner).agg(*[F.max(f"_t{i}").alias(f"_t{i}") for i in range(len(terms))])
    stats = per_owner.agg(F.count(F.lit(1)).alias("_N"), *[F.count_if(f"_t{i}").alias(f"_d{i}") for i in range(len(terms))])
    both = held.join(F.broadcast(stats))  # one row
    weights = {f"_w{i}": F.when(F.col(f"_t{i}"), F.log(1 + F.col("_N") / F.col(f"_d{i}"))).otherwise(0.0) for i in range(len(terms))}
    return both.withColumns(weights).drop(*[f"_t{i}" for i in range(len(terms))], *[f"_d{i}" for i in range(len(terms))], "_N"), terms


def _best_of(rows: DataFrame, scores: list[Column], owner: str, matched: Column | None, k: int) -> DataFrame:
    """(run_no, owner, rank, matched): the k best owners of each question, an owner counting once by its best row."""
    each = rows.select(owner, *([matched.alias("_m")] if matched is not None else [F.lit(None).cast("string").alias("_m")]), "_o", F.explode(F.array(*[F.struct(F.lit(q).alias("run_no"), s.alias("score")) for q, s in enumerate(scores)])).alias("_r"))
    hits = each.select("_r.run_no", owner, F.round("_r.score", 8).alias("score"), "_m", "_o")
    best = hits.groupBy("run_no", owner).agg(F.max(F.struct("score", (-F.col("_o")).alias("o"), "_m")).alias("_b")).select("run_no", owner, "_b.score", F.col("_b._m").alias("matched"))
    return R.ranked(best, ["run_no"], k=k, id_col=owner, digits=8)


def channel_runs(titles: DataFrame, headings: DataFrame, vectors: DataFrame, questions: list[tuple[list[str], list[float]]], owner: str = "owner", title: str = "title", heading: str = "heading", vector: str = "vector", kind: str | None = None, k: int = PER_RUN) -> DataFrame:
    """(run_no, channel, owner, rank, matched) of the four channels of all questions, each channel one pass.

    A question is (terms, vector). A ``kind`` is filtered before anything is counted or ranked, so
    statistics are of that kind and lists are full of it. Owners that hold no term are not found by
    words; those without a vector not by vectors.
    """
    if kind is not None:
        own = titles.where(F.col("kind") == kind)
        names = own.select(owner)
        titles, headings, vectors = own, headings.join(names, owner, "left_semi"), vectors.join(names, owner, "left_semi")
    terms = sorted({t for q, _ in questions for t in q})

    def lexical(rows: DataFrame, text: str, matched: Column | None) -> DataFrame:
        weighted, _ = _weights(rows, terms, text, owner)
        scores = [sum((F.col(f"_w{terms.index(t)}") for t in q), F.lit(0.0)) for q, _ in questions]
        some = F.lit(False)
        for s in scores:
            some = some | (s > 0)
        return _best_of(weighted.where(some), [F.when(s > 0, s) for s in scores], owner, matched, k).where("score is not null")

    def dense(rows: DataFrame, matched: Column | None) -> DataFrame:
        return _best_of(rows.where(F.col(vector).isNotNull()), [R.inner(F.col(vector), v) for _, v in questions], owner, matched, k)

    titles, headings, vectors = titles.withColumn("_o", F.lit(0)), headings.withColumn("_o", F.col("ordinal")), vectors.withColumn("_o", F.lit(0))
    found = (lexical(titles, title, None), dense(vectors, None), lexical(headings, heading, F.lower(heading)), dense(headings, F.col(heading)))
    out = None
    for c, run in enumerate(found):
        part = run.select((F.col("run_no") * len(CHANNELS) + c).alias("run_no"), F.lit(CHANNELS[c]).alias("channel"), owner, "rank", "matched")
        out = part if out is None else out.unionByName(part)
    return out


def pool(runs: DataFrame, titles: DataFrame, contents: DataFrame, limit: int, owner: str = "owner") -> DataFrame:
    """(owner, score, channels, matched_headings, rank): runs fused and normalised, the first ``limit`` of three times as many.

    An owner with contents (``contents``: owners) could have been found by every run, others by the
    title runs only; runs that found nothing do not count. Owners without a title row are passed
    over, which is what the over-fetch is for.
    """
    heading = F.col("channel").startswith("heading")
    counts = runs.agg(F.count_distinct(F.when(~heading, F.col("run_no"))).alias("_title"), F.count_distinct(F.when(heading, F.col("run_no"))).alias("_heading"))
    fused = runs.groupBy(owner).agg(
        F.sum(1.0 / (R.RRF_K + F.col("rank"))).alias("_s"),
        F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"),
        F.array_sort(F.collect_list(F.when(F.col("matched").isNotNull(), F.struct("rank", "run_no", "matched")))).alias("_why"),
    )
    sized = fused.join(contents.select(owner).distinct().withColumn("_c", F.lit(True)), owner, "left").join(F.broadcast(counts))  # one row
    eligible = F.col("_title") + F.when(F.col("_c"), F.col("_heading")).otherwise(0)
    scored = sized.withColumn("score", F.round(F.col("_s") / F.when(eligible > 0, eligible).otherwise(1), 8))
    order = Window.orderBy(F.desc("score"), owner)
    fetched = scored.orderBy(F.desc("score"), owner).limit(OVER * limit)
    looked_up = fetched.join(titles.select(owner), owner, "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    named = F.slice(F.array_distinct(F.transform("_why", lambda w: w["matched"])), 1, NAMED)
    return looked_up.select(owner, "score", "channels", named.alias("matched_headings"), "rank")


def shortlist(titles: DataFrame, headings: DataFrame, vectors: DataFrame, questions: list[tuple[list[str], list[float]]], limit: int = 25, primary: str | None = None, owner: str = "owner", **names: str) -> DataFrame:
    """(owner, rank, channels, matched_headings): half of the list from the primary kind's own ranking, then the open one without repeats."""
    runs = written(channel_runs(titles, headings, vectors, questions, owner, **names))
    every = pool(runs, titles, headings, limit, owner).withColumn("_list", F.lit(1))
    wanted = int(limit * PRIMARY_SHARE) if primary is not None else 0
    if wanted:
        of_kind = written(channel_runs(titles, headings, vectors, questions, owner, kind=primary, **names))
        every = written(every)
        first = written(pool(of_kind, titles.where(F.col("kind") == primary), headings, wanted, owner).withColumn("_list", F.lit(0)))
        every = first.unionByName(every.join(first.select(owner), owner, "left_anti"))
    ranked = every.withColumn("rank", F.row_number().over(Window.orderBy("_list", "rank", owner)))
    return ranked.where(F.col("rank") <= limit).select(owner, "rank", "channels", "matched_headings")
