"""What a retrieval leaves out, and why: an ordered cascade of causes with its provenance.

A section is suppressed for the first cause that names it; the later ones are kept beside it. A
cause may depend on what the causes before it have taken.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings under which an instrument summarises its own provisions.
OUTLINE = r"(?i)\b(simplified outline|outline of this (?:part|division|chapter|act|schedule)|guide to this (?:part|division|chapter|act)|overview of this (?:part|division|chapter|act))"
# The three things that the title of a decided case says, all of them.
CASE_STEP = r"(?i)\b(?:notice|notis|notification)\b[^.]{0,90}?\b(?:initiation|commencement|termination|discontinuance|determination|findings?|extension of (?:the )?time)\b"
CASE_PROCEEDING = r"(?i)\b(?:investigation|inquiry|enquiry|review of|proceedings?|petition|complaint)\b"
CASE_PARTICULARS = r"(?i)\b(?:with regard to|in respect of|in the matter of|imports? of|exported (?:from|by))\b"
# The figures that a translation keeps, and the numbers of the parts that a section is filed under.
FIGURE, PART_NUMBER = r"[0-9]+(?:\.[0-9]+)*[A-Z]{0,2}(?![A-Za-z0-9_])", r"(?<![A-Za-z0-9_])(?:[0-9]+[A-Z]?|[IVXLC]+)(?![A-Za-z0-9_])"
#: Length of a translation against its original, and the least likeness of the figures of both (fixed values).
SHORTEST, LONGEST, LIKENESS = 0.5, 2.2, 0.5


def figures(text: Column, label: Column) -> Column:
    """The different figures that a section cites, but for its own number."""
    own = F.upper(F.regexp_replace(F.coalesce(label.cast("string"), F.lit("")), r"[.\s]+$", ""))
    every = F.transform(F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0)), lambda f: F.upper(f))
    return F.array_remove(F.array_distinct(every), own)


def places(path: Column) -> Column:
    """The numbers of the parts above a section in a path of headings joined by `` > ``."""
    above = F.regexp_extract(F.coalesce(path, F.lit("")), r"^(?s)(.*) > ", 1)
    return F.array_distinct(F.transform(F.regexp_extract_all(above, F.lit(PART_NUMBER), F.lit(0)), lambda f: F.upper(f)))


def _matched(group: pd.DataFrame) -> pd.DataFrame:
    """One label of one instrument: its sections in other languages, in order, against those in the rubric's."""
    rubric = {r.id: r for r in group[group["rubric"]].itertuples()}
    holders: dict[str, list[int]] = {}
    for r in rubric.values():
        for f in r.figures:
            holders.setdefault(f, []).append(r.id)
    sets = {i: (set(r.figures), set(r.places)) for i, r in rubric.items()}
    free, pairs = set(rubric), []
    for o in group[~group["rubric"]].sort_values(["position", "id"]).itertuples():
        mine, where = set(o.figures), set(o.places)

        def fits(c: int) -> bool:
            there = sets[c][1]
            return c in free and SHORTEST <= o.length / max(1, rubric[c].length) <= LONGEST and (not where or not there or bool(where & there))

        if mine:
            shared: dict[int, int] = {}
            for f in mine:
                for c in holders.get(f, ()):
                    shared[c] = shared.get(c, 0) + 1
            likeness = {c: n / (len(mine) + len(sets[c][0]) - n) for c, n in shared.items()}
            scored = sorted((v for c, v in likeness.items() if v >= LIKENESS and fits(c)), reverse=True)
            best = [c for c, v in likeness.items() if scored and v == scored[0] and fits(c)]
        else:  # without figures only a lone candidate can be told
            best = [c for c in free if len(free) == 1 and not sets[c][0] and fits(c)]
        if len(best) == 1:
            free.discard(best[0])
            pairs.append((o.id, best[0]))
    return pd.DataFrame(pairs, columns=["id", "original"]).astype("int64")


def other_language_copies(sections: DataFrame, id_col: str = "doc_id", instrument: str = "source", label: str = "label", language: str = "lang", text: str = "text", path: str | None = None, position: str | None = None, rubric: str = "en") -> DataFrame:
    """(id, original): sections in another language that repeat one in the rubric's language.

    Candidates share instrument and label, are of a length a translation could have, are not filed
    under parts of other numbers, and cite the same figures, at least half of them; without figures
    only a lone candidate is told. The best is taken if it is the only best one; sections are matched
    one to one, in their order. Only labels held in both languages are looked at, and of those only
    lengths, figures and part numbers travel, not texts. Rows without id, label or language take no
    part; null texts count as empty.
    """
    own = sections.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(language).isNotNull())
    body = F.coalesce(F.col(text), F.lit(""))
    row = own.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(instrument).alias("instrument"),
        F.col(label).alias("label"),
        (F.col(language) == rubric).alias("rubric"),
        F.char_length(body).alias("length"),
        figures(body, F.col(label)).alias("figures"),
        (places(F.col(path)) if path else F.array().cast("array<string>")).alias("places"),
        F.col(position or id_col).cast("long").alias("position"),
    )
    both = row.groupBy("instrument", "label").agg(F.min("rubric").alias("some_other"), F.max("rubric").alias("some_own")).where("some_own and not some_other")
    pairable = row.join(both.select("instrument", "label"), ["instrument", "label"], "left_semi")
    return pairable.groupBy("instrument", "label").applyInPandas(lambda g: _matched(g), "id long, original long").withColumnRenamed("id", id_col)


def outlines(sections: DataFrame, id_col: str = "doc_id", headings: tuple[str, ...] = ("heading",), pattern: str = OUTLINE) -> DataFrame:
    """Sections whose label or heading says that they summarise their instrument."""
    hit = F.lit(False)
    for h in headings:
        hit = hit | F.coalesce(F.col(h).cast("string").rlike(pattern), F.lit(False))
    return sections.where(hit).select(id_col)


def decided_cases(sections: DataFrame, id_col: str = "doc_id", title: str = "heading", patterns: tuple[str, ...] = (CASE_STEP, CASE_PROCEEDING, CASE_PARTICULARS)) -> DataFrame:
    """Sections of documents whose title says all of what the title of a decided case says."""
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(title), F.lit("")), r"\s+", " "))
    hit = F.lit(True)
    for p in patterns:
        hit = hit & plain.rlike(p)
    return sections.where(hit).select(id_col)


def second_registrations(sections: DataFrame, id_col: str = "doc_id", within: tuple[str, ...] = ("source",), content: str = "digest", stands: str = "stands") -> DataFrame:
    """Of equal contents all but one: the first that states a number or standing stays, else the first of all.

    One aggregate by digest gives the row that stays; texts do not travel.
    """
    keys = [*within, content]
    first = sections.groupBy(*keys).agg(F.min(F.struct(~F.coalesce(F.col(stands), F.lit(False)), F.col(id_col))).alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.col(f"_kept.{id_col}").alias("_kept"))
    return sections.select(id_col, *keys).join(first, keys).where(F.col(id_col) != F.col("_kept")).select(id_col)


def repeated_provisions(sections: DataFrame, taken: DataFrame, id_col: str = "doc_id", instrument: str = "source", content: str = "digest", stands: str = "stands") -> DataFrame:
    """Provisions of bare instruments whose words stand in an identified one that is still read.

    ``taken`` holds the ids that are suppressed already: a copy goes only if an identified section
    of another instrument with the same words is not among them. Empty texts take no part.
    """
    rows = sections.where("length > 0") if "length" in sections.columns else sections
    live = rows.select(id_col, instrument, content, F.coalesce(F.col(stands), F.lit(False)).alias("_stands")).join(taken.select(id_col).distinct().withColumn("_taken", F.lit(True)), id_col, "left")
    facts = live.groupBy(content).agg(F.min(instrument).alias("_a"), F.max(instrument).alias("_b"), F.max(F.col("_stands") & F.col("_taken").isNull()).alias("_kept")).where("_a <> _b and _kept")
    return live.where(~F.col("_stands")).join(facts.select(content), content, "left_semi").select(id_col)


def cascade(causes: list[tuple[str, Callable[[DataFrame], DataFrame]]], nothing: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, reason, reasons): every suppressed id with its first cause and all of them in order.

    ``causes`` are names and functions from what is taken so far to ids; ``nothing`` is a frame of
    ids without rows. All causes are gathered by one aggregate, whatever their number.
    """
    taken = nothing.select(F.col(id_col), F.lit(0).alias("_k"), F.lit("").alias("_name"))
    for k, (name, cause) in enumerate(causes):
        taken = taken.unionByName(cause(taken.select(id_col)).select(id_col, F.lit(k).alias("_k"), F.lit(name).alias("_name")))
    every = taken.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("_k", "_name"))).alias("_all"))
    names = F.transform("_all", lambda x: x["_name"])
    return every.select(id_col, names[0].alias("reason"), names.alias("reasons"))


def appended(first: DataFrame, more: DataFrame, id_col: str = "doc_id", rank: str = "rank") -> DataFrame:
    """``first`` untouched, then those of ``more`` that it does not hold, in their order, ranked behind it.

    Both are lists that a depth bounds, so one window ranks them.
    """
    both = first.withColumn("_list", F.lit(0)).unionByName(more.join(first.select(id_col), id_col, "left_anti").withColumn("_list", F.lit(1)), allowMissingColumns=True)
    return both.withColumn(rank, F.row_number().over(Window.orderBy("_list", rank, id_col))).drop("_list")
