"""Pages to citable sections with exact character offsets, robots rules, text windows, table packing."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below so many characters a page holds no text worth citing; above this share of link text it is a landing page (fixed values).
LEAST_TEXT, MOST_LINKS = 600, 0.5
#: Windows of a long text, their overlap, and how far a break may be sought (fixed values).
WINDOW, OVERLAP, REACH = 12000, 1500, 0.6
#: Characters of sections that a worker holds before they leave.
HELD = 1 << 20

_CHROME = re.compile(r"<(script|style|nav|header|footer|aside|form|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
_HEADING = re.compile(r"<h([1-6])\b[^>]*>(.*?)(?=</h\1|<h[1-6]|\Z)", re.I | re.S)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|main|body|title|head|html)\b[^>]*>", re.I)
_CELL = re.compile(r"</?t[dh]\b[^>]*>", re.I)


def readable(markup: str) -> str:
    """Lines of text: blocks end lines, cells are set apart by a blank, inline markup goes."""
    text = _CELL.sub(" ", _BLOCK.sub("\n", markup))
    text = html.unescape(re.sub(r"<[^>]*>", "", text)).replace("\xa0", " ")
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def sections(markup: str | None) -> tuple[str | None, list[tuple[str, str, int, int]]]:
    """(why it was not read or None, [(heading path, text, start, end)]); offsets are those in the joined texts."""
    bare = _CHROME.sub(" ", markup or "")
    whole = readable(bare)
    if len(whole) < LEAST_TEXT:
        return "empty", []
    linked = sum(len(readable(a)) for a in re.findall(r"<a\b[^>]*>(.*?)</a", bare, re.I | re.S))
    if linked > MOST_LINKS * len(whole):
        return "landing-page", []
    found, parts, trail = list(_HEADING.finditer(bare)), [], []
    for k, h in enumerate(found):
        level, title = int(h[1]), readable(h[2])
        trail = [x for x in trail if x[0] < level] + [(level, title)]
        text = readable(bare[h.end() : found[k + 1].start() if k + 1 < len(found) else len(bare)])
        if text:
            parts.append((" > ".join(x[1] for x in trail), text))
    if not parts:
        numbered = re.split(r"(?m)^(?=\d+\.\s)", whole)
        parts = [("", p.strip()) for p in numbered if p.strip()]
    out, at = [], 0
    for path, text in parts:
        out.append((path, text, at, at + len(text)))
        at += len(text) + 2
    return None, out


def parsed(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each section of each page; a page that was not read has one row that says why.

    Sections leave in small batches while pages are read one by one, so what a worker holds besides
    a batch of its input does not grow with it.
    """
    names = [id_col, "ordinal", "heading_path", "text", "char_start", "char_end", "unread"]
    form = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form)
        for batch in batches:
            rows, held = [], 0
            for page, markup in zip(batch.column(0), batch.column(1)):
                why, own = sections(markup.as_py())
                page = page.as_py()
                rows += [(page, k, *s, None) for k, s in enumerate(own)] if own else [(page, 0, None, None, None, None, why or "empty")]
                held += sum(len(s[1]) for s in own) + 1
                if held > HELD or len(rows) > HELD >> 8:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return pages.select(F.col(id_col).cast("long").alias(id_col), html_col).mapInArrow(run, f"{id_col} long, ordinal int, heading_path string, text string, char_start long, char_end long, unread string")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, allow, rule, pattern) from (host, body): the groups of an agent, wildcards as a regular expression."""
    line = F.posexplode(F.split("body", r"\r?\n"))
    lines = robots.select("host", line.alias("n", "line")).select("host", "n", F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1).alias("key"), F.trim(F.regexp_replace(F.regexp_extract("line", r":(.*)$", 1), "#.*$", "")).alias("value"))
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    group = F.last(F.when(F.lower("key") == "user-agent", F.lower("value")), ignorenulls=True).over(w)
    rules = lines.withColumn("agent", group).where((F.col("agent") == agent) & F.lower("key").isin("allow", "disallow") & (F.col("value") != ""))
    quoted = F.regexp_replace(F.regexp_replace("value", r"([.+?^(){}|\[\]\\])", r"\\$1"), r"\*", ".*")
    return rules.select("host", (F.lower("key") == "allow").alias("allow"), F.col("value").alias("rule"), F.concat(F.lit("^"), quoted).alias("pattern"))


def permitted(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``allowed`` of (host, path): the longest rule that fits wins, allow wins ties, no rule permits."""
    fits = urls.join(rules, "host").where(F.expr("path rlike pattern"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), "allow")).alias("best"))
    return urls.distinct().join(best, ["host", "path"], "left").select("host", "path", F.coalesce("best.allow", F.lit(True)).alias("allowed"))


def windows(text: str | None, size: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Overlapping spans of a text that end at a paragraph or sentence where one is near enough."""
    text, out, at = text or "", [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n", ". "):
                cut = text.rfind(mark, at + int(size * REACH), end)
                if cut > 0:
                    end = cut + len(mark)
                    break
        out.append((at, end))
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def windowed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(id, nth, start, end) of the windows of each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(i, k, a, b) for i, t in zip(frame[id_col], frame[text_col]) for k, (a, b) in enumerate(windows(t, size, overlap))], columns=[id_col, "nth", "start", "end"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, nth int, start long, end long")


def greedy_bins(sizes: Column, most: int) -> Column:
    """The bin of each element when an ordered array is packed greedily into bins of at most ``most``."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("bin"), F.array().cast("array<int>").alias("bins"))

    def step(s: Column, x: Column) -> Column:
        new = (s["used"] > 0) & (s["used"] + x > most)
        number = s["bin"] + new.cast("int")
        return F.struct(F.when(new, x).otherwise(s["used"] + x).cast("long").alias("used"), number.alias("bin"), F.concat(s["bins"], F.array(number)).alias("bins"))

    return F.aggregate(sizes, start, step, lambda s: s["bins"])


def running_headers(lines: DataFrame) -> DataFrame:
    """(doc, header) from (doc, page, i, line): the line that most pages repeat, with its neighbours if they go along.

    A header stands on three pages and on 15 % of them at least, in a document of four pages or more;
    a neighbour line belongs to it if it is one itself and stands beside it on 80 % of its pages.
    Ties go to the longer line, then to the one that sorts last.
    """
    text = F.trim(F.regexp_replace("line", r"\s+", " "))
    letters = F.char_length(F.regexp_replace(text, "[^A-Za-z]", ""))
    named = lines.select("doc", "page", "i", text.alias("text"), F.lower(text).alias("key"), letters.alias("letters")).where(F.char_length("text").between(12, 160) & (F.col("letters") >= 0.6 * F.char_length("text")))
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages")).where("pages >= 4")
    once = named.groupBy("doc", "key", "page").agg(F.min("i").alias("i"), F.min("text").alias("text"))
    often = once.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text")).join(pages, "doc").where("n >= 3 and n >= 0.15 * pages")
    best = often.groupBy("doc").agg(F.max(F.struct("n", F.char_length("text").alias("size"), "key", "text")).alias("best")).select("doc", "best.*")
    places = once.join(best.select("doc", "key", F.col("n").alias("of")), ["doc", "key"]).select("doc", "page", "of", F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("i") - 1).alias("i")), F.struct(F.lit(2).alias("side"), (F.col("i") + 1).alias("i")))).alias("x")).select("doc", "page", "of", "x.*")
    votes = places.join(named.select("doc", "page", "i", "key"), ["doc", "page", "i"]).groupBy("doc", "side", "key", "of").agg(F.count(F.lit(1)).alias("votes")).where("votes >= 0.8 * of")
    beside = votes.join(often.select("doc", "key", "text"), ["doc", "key"]).groupBy("doc", "side").agg(F.max_by("text", F.struct("votes", "key")).alias("text"))
    every = best.select("doc", F.lit(1).alias("side"), "text").unionByName(beside)
    return every.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "text"))), lambda x: x["text"]), " ").alias("header"))
