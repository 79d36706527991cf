"""Page furniture: running heads, feet and page numbers at the edges of a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grammar import PART_LINE, PART_SPLIT, SHORT, number

# A page number alone, and the least pages and shares of a document's pages that carry a line of furniture (with words, without).
PAGE_NUMBER = r"(?i)^(?:page\s+)?[ivxlcdm0-9]+(?:\s*(?:of|/)\s*[ivxlcdm0-9]+)?$"
LEAST_PAGES, LEAST_SHARE, LEAST_NUMBERS = 3, 0.15, 0.6
#: Pages of a document, lines of a page, lines of an edge, and length of a line that are looked at.
PAGES, LINES, EDGE, LENGTH, WORDS = 4, 6, 2, 120, 4


def key(line: Column) -> Column:
    """The words of a line, by which it is known from page to page; a bare page number has none."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, "[^A-Za-z ]+", " "), r"\s+", " ")))


def structural(line: Column) -> Column:
    """Whether a line opens a provision or a part, and so is never furniture."""
    split = (F.char_length(line) < SHORT) & F.regexp_replace(line, r"\s+", "").rlike(PART_SPLIT)
    return (number(line) != "") | line.rlike(PART_LINE) | split


def without_furniture(lines: DataFrame, doc: str = "doc", page: str = "page", at: str = "i", line: str = "line") -> DataFrame:
    """(doc, page, i, line) without the lines that repeat at the edges of a document's pages.

    In a document of four pages or more, the two lines at either edge of a page of six lines or more
    are furniture if their words stand at the edges of three pages and of 15 % of all; a page number
    alone has to stand on 60 %. Lines that open a provision or a part, and long ones, stay. Lines are
    counted by their words in one aggregate, so only edges travel. Null lines are lines that stay.
    """
    n = F.count(F.lit(1))
    sizes = lines.groupBy(doc, page).agg(n.alias("_n"), F.min(at).alias("_first"))
    pages = sizes.groupBy(doc).agg(n.alias("_pages"))
    placed = lines.join(sizes, [doc, page]).withColumn("_place", F.col(at) - F.col("_first"))
    edge = (F.col("_n") >= LINES) & ((F.col("_place") < EDGE) | (F.col("_place") >= F.col("_n") - EDGE))
    known = F.coalesce(edge & (F.char_length(line) <= LENGTH) & ~structural(F.col(line)) & ((F.char_length(key(F.col(line))) >= WORDS) | F.trim(line).rlike(PAGE_NUMBER)), F.lit(False))
    marked = placed.withColumn("_key", F.when(known, key(F.col(line))))
    often = marked.where("_key is not null").groupBy(doc, "_key").agg(F.count_distinct(page).alias("_on")).join(pages, doc)
    share = F.when(F.col("_key") == "", LEAST_NUMBERS).otherwise(LEAST_SHARE)
    gone = often.where((F.col("_pages") >= PAGES) & (F.col("_on") >= LEAST_PAGES) & (F.col("_on") >= F.col("_pages") * share)).select(doc, "_key")
    return marked.join(gone.withColumn("_gone", F.lit(True)), [doc, "_key"], "left").where("_gone is null").select(doc, page, at, line)
