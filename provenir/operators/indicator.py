"""Retrieval for one indicator: questions on two channels, seats, governing instruments, what is followed.

All questions are counted in one pass over the texts and one over the vectors; from there on only
lists travel whose length a depth bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.events import shared_folder
from . import retrieval as R
from .suppression import appended

#: What a pointer may bring in, what a cell may take in all, how many words both must share (fixed values).
PER_POINTER, PER_CELL, LEAST_SHARED = 2, 6, 3
#: Instruments that are read for a code beyond the depth, and how far down the lexical lists they are looked for (fixed values).
CODED_SEATS, CODED_SCAN = 12, 3000
# Words that leave an amount to another provision, that state one, and that leave a stated one open.
LEAVES_AMOUNT = r"(?i)\b(?:such\s+other\s+(?:amount|sum|value)\s+as\s+(?:is|may\s+be)\s+(?:prescribed|specified|determined)|(?:a|the)\s+prescribed\s+(?:amount|sum|value|price))\b"
STATES_AMOUNT = r"(?i)(?:US\s?\$|A\s?\$|S\s?\$|\bRM|₹|\$)\s?\d|\d[\d,. ]*\s?(?:dollars?|ringgit|rupees?|baht)\b|\b(?:hundred|thousand|million)\s+(?:\w+\s+){0,3}?(?:dollars?|ringgit|rupees?|baht)\b"
# Words that say nothing about what a clause is about.
EMPTY_WORDS = ["that", "this", "which", "with", "from", "have", "been", "shall", "must", "under", "other", "such", "than", "into", "upon", "where", "there", "their", "these", "those", "within", "made", "being", "does", "section", "paragraph", "subsection", "prescribed", "amount"]


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lexical_runs(docs: DataFrame, questions: list[list[str]], k: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(run_no, id, score, rank): the ``k`` best of each question by BM25; a question is a list of terms.

    One pass counts all terms of all questions; the counts are written, so the statistics and the
    scores do not read the texts again.
    """
    terms = sorted({t for q in questions for t in q})
    body = F.coalesce(F.col(text), F.lit(""))
    some = " or ".join(f"_f{i} > 0" for i in range(len(terms)))
    counted = written(docs.select(F.col(id_col), R.grams(body).alias("_d"), *[R.occurrences(body, t).alias(f"_f{i}") for i, t in enumerate(terms)]))
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_d").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(terms))])
    both = counted.where(some).join(F.broadcast(stats))  # one row
    runs = []
    for no, own in enumerate(questions):
        total, hit = F.lit(0.0), F.lit(False)
        for i in (terms.index(t) for t in own):
            idf = F.log((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
            f = F.col(f"_f{i}")
            total = total + F.when(idf > 0, idf).otherwise(F.lit(R.IDF_FLOOR)) * f * (R.K1 + 1) / (f + R.K1 * (1 - R.B + R.B * F.col("_d") / F.col("_avg")))
            hit = hit | (f > 0)
        runs.append(F.when(hit, F.struct(F.lit(no).alias("run_no"), total.alias("score"))))
    each = both.select(id_col, F.explode(F.array_compact(F.array(*runs))).alias("_r")).select("_r.run_no", id_col, "_r.score")
    return R.ranked(each, ["run_no"], k=k, id_col=id_col)


def dense_runs(vectors: DataFrame, questions: list[list[float]], k: int, vector: str = "embedding", id_col: str = "doc_id") -> DataFrame:
    """(run_no, id, score, rank): the ``k`` best of each question vector by inner product, all in one pass."""
    scores = [F.struct(F.lit(no).alias("run_no"), R.inner(F.col(vector), q).alias("score")) for no, q in enumerate(questions)]
    each = vectors.select(id_col, F.explode(F.array(*scores)).alias("_r")).select("_r.run_no", id_col, "_r.score")
    return R.ranked(each, ["run_no"], k=k, id_col=id_col)


def search_runs(lexical: DataFrame | None, dense: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """(run_no, channel, id, rank) of both channels, a question's lexical run before its dense one."""
    parts = [r.select((F.col("run_no") * 2 + second).alias("run_no"), F.lit(channel).alias("channel"), id_col, "rank") for second, (channel, r) in enumerate((("lexical", lexical), ("dense", dense))) if r is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@dataclass
class Depths:
    """How deep a search goes: columns that depend on the size of the corpus, and the rank that bounds them."""

    seats: Column
    per_question: Column
    most: int = 2 * R.PER_QUERY


def depths(size: Column) -> Depths:
    return Depths(R.adaptive_depth(size, R.DEPTH), R.adaptive_depth(size, R.PER_QUERY))


def seated_search(runs: DataFrame, owners: DataFrame, governing: DataFrame, size: DataFrame, skip: DataFrame, id_col: str = "doc_id", owner: str = "source") -> DataFrame:
    """(id, channels, rank, seat): one search from its runs.

    What is suppressed (``skip``: ids) leaves the runs, which keep their ranks for the fusion; each
    run then seats its own best, the fused rest follows, an owner's hits beyond its share move back,
    the list is cut at the depth, and each of the ``governing`` owners (owner, place) adds up to six
    hits of its own by their best rank in any run. ``size`` is a row with the corpus' size ``n``.
    """
    d = depths(F.col("n"))
    asked = runs.join(F.broadcast(size)).where(F.col("rank") <= d.per_question).drop("n")  # one row
    kept = asked.join(skip.select(id_col), id_col, "left_anti")
    nth = kept.withColumn("_nth", F.row_number().over(Window.partitionBy("run_no").orderBy("rank", id_col)))
    fused = R.fused(kept, id_col)
    seats = nth.where(F.col("_nth") <= R.SEATS).groupBy(id_col).agg(F.min(F.struct("_nth", "run_no")).alias("_seat"))
    best = kept.groupBy(id_col).agg(F.min("rank").alias("_best"))
    merit = Window.orderBy(F.col("_seat").isNull(), F.col("_seat._nth"), F.col("_seat.run_no"), F.desc("score"), id_col)
    ordered = fused.join(seats, id_col, "left").join(best, id_col).withColumn("_merit", F.row_number().over(merit)).join(owners.select(id_col, owner), id_col)
    over = F.row_number().over(Window.partitionBy(owner).orderBy("_merit")) > R.PER_SOURCE
    placed = ordered.withColumn("_over", over).withColumn("_pos", F.row_number().over(Window.orderBy("_over", "_merit"))).join(F.broadcast(size)).withColumn("_deep", F.col("_pos") > d.seats)
    held = placed.where("not _deep").select(id_col, "channels", F.lit("depth").alias("seat"), F.lit(0).alias("_place"), F.col("_pos").alias("_n"))
    extra = placed.where("_deep").join(F.broadcast(governing.select(owner, F.col("place").alias("_place"))), owner).withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy("_best", "_merit"))).where(F.col("_n") <= R.GOVERNING_EACH)
    every = held.unionByName(extra.select(id_col, "channels", F.lit("governing").alias("seat"), "_place", "_n"))
    return every.withColumn("rank", F.row_number().over(Window.orderBy(F.col("seat") != "depth", "_place", "_n"))).drop("_place", "_n")


def content_words(text: Column) -> Column:
    """The different words of four letters or more that say what a clause is about."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))), F.array(*map(F.lit, EMPTY_WORDS)))


def _followed(rows: pd.DataFrame) -> pd.DataFrame:
    """Pointers in order: each takes its best free targets until the cell is full."""
    taken, out = set(), []
    for place, own in rows.sort_values(["rank", "nth"]).groupby("rank", sort=True):
        free = [i for i in own["target"] if i not in taken][: min(PER_POINTER, PER_CELL - len(out))]
        taken.update(free)
        out += [(i, place, k) for k, i in enumerate(free)]
    return pd.DataFrame(out, columns=["target", "behind", "nth"]).astype({"target": "int64", "behind": "int32", "nth": "int32"})


def prescribed(found: DataFrame, sections: DataFrame, id_col: str = "doc_id", owner: str = "source", text: str = "text", leaves: str = LEAVES_AMOUNT, states: str = STATES_AMOUNT, open_figure: str | None = None) -> DataFrame:
    """(target, behind, nth): sections that state what a found one leaves to be prescribed.

    Followed within the pointer's owner, to sections that state an amount outright and leave none
    open; those that cite the pointing clause's own reference come first, then those that share most
    words with it for their length; two a pointer, six in all, none that is found already.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    pointers = found.select(id_col, "rank").join(sections.select(id_col, owner, body.alias("_t")), id_col).where(F.col("_t").rlike(leaves))
    at = F.regexp_instr("_t", F.lit(leaves), F.lit(0))
    clause = F.substring("_t", F.greatest(at - 400, F.lit(1)), F.least(at - 1, F.lit(400)) + 200)
    pointers = pointers.select("rank", owner, content_words(clause).alias("_words"), F.regexp_extract_all(clause, F.lit(r"\b[0-9]+[A-Z]?(?:\(\w+\))+"), F.lit(0)).alias("_refs"))
    outright = body.rlike(states) & ~body.rlike(leaves) & (~body.rlike(open_figure) if open_figure else F.lit(True))
    targets = sections.where(outright).select(F.col(id_col).alias("target"), owner, body.alias("_t"), content_words(body).alias("_theirs")).join(found.select(F.col(id_col).alias("target")), "target", "left_anti")
    both = targets.join(F.broadcast(pointers), owner)  # the pointers of a list that a depth bounds
    shared = F.size(F.array_intersect("_words", "_theirs"))
    cites = F.exists("_refs", lambda r: F.contains(F.col("_t"), r))
    scored = both.select("rank", "target", cites.alias("_cites"), shared.alias("_shared"), (shared / F.sqrt(F.greatest(F.size("_theirs"), F.lit(1)))).alias("_share")).where((F.col("_shared") >= LEAST_SHARED) | F.col("_cites"))
    nth = F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("_cites"), F.desc("_share"), "target"))
    few = scored.withColumn("nth", nth).where(F.col("nth") <= PER_POINTER + PER_CELL).select("rank", "target", "nth")
    return few.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda g: _followed(g.drop(columns="_one")), "target long, behind int, nth int")  # eight rows a pointer at most


def coded(lexical: DataFrame, sections: DataFrame, found: DataFrame, skip: DataFrame, measure: str, code: str, id_col: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """(id, rank): one section of each owner that the questions reach and that names a code and the measure, best rank first."""
    best = lexical.groupBy(id_col).agg(F.min("rank").alias("_best")).join(skip.select(id_col), id_col, "left_anti").join(found.select(id_col), id_col, "left_anti")
    own = sections.where(F.col(text).rlike(measure) & F.col(text).rlike(code)).select(id_col, owner)
    first = best.join(own, id_col).groupBy(owner).agg(F.min(F.struct("_best", id_col)).alias("_first"))
    return first.select(f"_first.{id_col}", F.row_number().over(Window.orderBy("_first")).alias("rank")).where(F.col("rank") <= CODED_SEATS)


def answered(first: DataFrame, again: DataFrame, followed: DataFrame | None = None, by_code: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, rank, channels, seat): the first search, what only the second reaches, what is followed just behind its pointer, what a code names last."""
    both = appended(first, again, id_col).select(id_col, "rank", "channels", "seat")
    if followed is not None:
        seats = followed.select(F.col("target").alias(id_col), F.col("behind").alias("rank"), F.lit("prescribed-by").alias("channels"), F.lit("followed").alias("seat"), (F.col("nth") + 1).alias("_n"))
        every = both.withColumn("_n", F.lit(0)).unionByName(seats)
        both = every.withColumn("rank", F.row_number().over(Window.orderBy("rank", "_n"))).drop("_n")
    if by_code is not None:
        both = appended(both, by_code.select(id_col, "rank", F.lit("tariff-code").alias("channels"), F.lit("coded").alias("seat")), id_col)
    return both
