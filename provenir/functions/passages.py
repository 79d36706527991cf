"""Quotes found in their sources, scripts folded, charsets, and what small wordings say."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .approximate import LAO_AM, LAO_HALVES, UNSPOKEN

# Typographic signs and what they count as in a quote.
SIGNS, PLAIN = "‘’‚‛′‐‑‒–—―−İ", "'''''-------i"
#: The least of a fragment, of the longest one, and of all together, in an elided quote.
FRAGMENT, ANCHOR, TOTAL = 3, 12, 40
# White space of all kinds; signs that are set around words and not spoken; Lao letters; Thai marks that sit on a letter.
_WHITE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_SIGN, _LAO, _THAI_MARK = "[" + UNSPOKEN + "]", "[຀-໿]", "[ัิ-ฺ็-๎]"


def folded(c: Column) -> Column:
    """Lower case and plain signs, character for character, so that places stay what they were."""
    return F.lower(F.translate(c, SIGNS, PLAIN))


def _spoken(c: Column) -> Column:
    """A folded wording without the signs that are not spoken, white space single, ends trimmed; Lao AM in one piece."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(c, _SIGN, ""), F.lit(LAO_HALVES), F.lit(LAO_AM)), f"{_WHITE}+", " "))


def _pattern(fragment: Column) -> Column:
    """A spoken fragment as a pattern over a folded text, which may be set with signs and any white space.

    Between two Lao letters, and before a mark that sits on a Thai letter, the text may have a blank.
    """

    def one(c: Column) -> Column:
        own = F.when(c == " ", f"{_WHITE}(?:{_WHITE}|{_SIGN})*").when(c == LAO_AM, f"(?:{LAO_AM}|{LAO_HALVES})").otherwise(F.concat(F.lit(r"\Q"), c, F.lit(r"\E")))
        before = F.when(c.rlike(_THAI_MARK), f"{_WHITE}*").when(c.rlike(_LAO), f"(?:(?<={_LAO}){_WHITE}+)?").otherwise("")
        return F.concat(before, own)

    return F.array_join(F.transform(F.regexp_extract_all(fragment, F.lit("(?s)."), F.lit(0)), one), f"{_SIGN}*")


def _fragments(quote: Column) -> Column:
    return F.filter(F.transform(F.split(folded(quote), r"\.\.\.|…"), _spoken), lambda p: p != "")


def quote_pattern(quote: Column) -> Column:
    """The pattern that finds a quote in a folded text; fragments of an elided one follow each other at any distance.

    A quote with gaps counts as elided only if its fragments carry enough words; a short fragment
    must stand as whole words. An empty quote has no pattern.
    """
    whole, parts = _spoken(folded(quote)), _fragments(quote)
    size = F.transform(parts, F.char_length)
    elided = whole.rlike(r"\.\.\.|…") & (F.size(parts) > 1) & (F.array_min(size) >= FRAGMENT) & (F.array_max(size) >= ANCHOR) & (F.char_length(F.array_join(parts, " ")) >= TOTAL)
    edge = "[a-z0-9Ѐ-ӿ]"
    each = F.transform(parts, lambda p: F.when(F.char_length(p) < ANCHOR, F.concat(F.lit(f"(?<!{edge})"), _pattern(p), F.lit(f"(?!{edge})"))).otherwise(_pattern(p)))
    return F.when(whole != "", F.when(elided, F.array_join(each, r"[\s\S]*?")).otherwise(_pattern(whole)))


def phrase_in(text: Column, phrase: Column) -> Column:
    """Whether a folded text holds a phrase of three characters or more, its fragments in order at any distance."""
    parts = _fragments(phrase)
    enough = (F.size(parts) > 0) & F.forall(parts, lambda p: F.char_length(p) >= FRAGMENT)
    return F.coalesce(enough & F.rlike(text, F.array_join(F.transform(parts, _pattern), r"[\s\S]*?")), F.lit(False))


def quote_span(text: Column, quote: Column) -> Column:
    """Where a quote stands in a text: struct(start, end) in characters, end excluded; null if it does not.

    The start is the length of what stands before, so characters of two code units count as one.
    """
    pattern, low = quote_pattern(quote), folded(text)
    found = F.regexp_substr(low, pattern)
    start = F.char_length(F.call_function("regexp_extract", low, F.concat(F.lit(r"^([\s\S]*?)(?:"), pattern, F.lit(")")), F.lit(1)))
    return F.when(found.isNotNull(), F.struct(start.alias("start"), (start + F.char_length(found)).alias("end")))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode's composed form."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def am_folded(c: Column) -> Column:
    """The Thai and Lao vowel AM as one character, however it was typed."""
    return F.replace(F.replace(c, F.lit("ํา"), F.lit("ำ")), F.lit("ໍາ"), F.lit("ຳ"))


def marks_rejoined(c: Column) -> Column:
    """Thai marks that a stray space has parted from the letter they sit on."""
    return F.regexp_replace(c, "([฀-๿]) (?=[ัิ-ฺ็-๎])", "$1")


def phrase(c: Column) -> Column:
    """A search phrase: words and single blanks; null if fewer than three characters are left."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(am_folded(c)), r"[^\p{L}\p{N}\p{M}\s]+", " "), r"\s+", " "))
    return F.when(F.char_length(F.replace(words, F.lit(" "), F.lit(""))) >= 3, words)


@F.pandas_udf(StringType())
def json_in(text: pd.Series) -> pd.Series:
    """The first JSON object in an answer that may say more than that."""
    read = json.JSONDecoder().raw_decode

    def first(s: str | None) -> str | None:
        at = (s or "").find("{")
        while at >= 0:
            try:
                return s[at : read(s, at)[1]]
            except ValueError:
                at = s.find("{", at + 1)
        return None

    return text.map(first)


def charset(body: Column, header: Column, media: Column) -> Column:
    """The encoding of a page: its byte-order mark, what the header names, what the page names, else UTF-8.

    A legacy encoding that is named over well-formed UTF-8 is a server's mistake, and does not count.
    """
    start = F.hex(F.substring(body, 1, 3))
    head = F.decode(F.substring(body, 1, 2048), "ISO-8859-1")
    markup = media.rlike("(?i)html|xml") | head.rlike(r"(?i)^\s*<(?:!doctype|html|\?xml|head)")
    declared = F.coalesce(F.nullif(F.regexp_extract(head, r"""(?i)<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9._:-]+)""", 1), F.lit("")), F.nullif(F.regexp_extract(head, r"""(?i)<\?xml[^>]+encoding\s*=\s*["']([A-Za-z0-9._:-]+)["']""", 1), F.lit("")))
    named = F.lower(F.coalesce(header, F.when(markup, declared), F.lit("utf-8")))
    mistaken = ~named.startswith("utf") & F.is_valid_utf8(body.cast("string"))
    return F.when(start.startswith("EFBBBF") | mistaken, "utf-8").when(start.startswith("FFFE"), "utf-16le").when(start.startswith("FEFF"), "utf-16be").otherwise(named)


def standing(heading: Column) -> Column:
    """What a listing's heading says of what is listed under it; one that says both says nothing."""
    line = F.trim(F.regexp_replace(F.coalesce(heading, F.lit("")), r"\s+", " "))
    current = line.rlike(r"(?i)\b(?:current|in[- ]force|existing|active)\b")
    past = line.rlike(r"(?i)\b(?:repealed|revoked|superseded|rescinded|historical|archive[ds]?|expired|previous|past)\b")
    return F.when(F.char_length(line) <= 200, F.when(past & ~current, "repealed").when(current & ~past, "in-force"))


def ago(minutes: Column) -> Column:
    """How long ago something was, as people say it (up to a month)."""
    hours, days = F.round(minutes / 60).cast("long"), F.round(F.round(minutes / 60) / 24).cast("long")
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.when(hours == 1, "1 hour ago").otherwise(F.concat(hours.cast("string"), F.lit(" hours ago"))))
        .when(days < 30, F.when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago"))))
    )


# Words of links that lead to law, and parts of a site that never do.
TO_LAW = (
    r"(?i)\b(?:legislat\w*|legal|regulat\w*|licen[cs]\w*|regist\w*|instruments?|documents?|gazettes?|statut\w*|codes?|guidelines?|standards?|acts?|rules?|orders?|determinations?|directions?|directives?"
    r"|circulars?|notices?|polic(?:y|ies)|complian\w*|enforce\w*)\b"
)
NOT_LAW = r"(?i)\b(?:news|media|press|events?|careers?|vacanc(?:y|ies)|contact|about-us|search|login|subscribe|rss|calendar|galler(?:y|ies)|videos?|podcasts?)\b"


def worth_opening(path: Column, text: Column) -> Column:
    """Whether a link may lead to law, by its path and its words."""
    return F.concat_ws(" ", path, text).rlike(TO_LAW) & ~F.coalesce(path, F.lit("")).rlike(NOT_LAW)


def excepted(exception: Column, government_only: Column, sector: Column, within: Column, target: Column, elsewhere: str) -> Column:
    """Why an indicator's stated exception takes a finding out; null if it does not.

    ``elsewhere``: a pattern of the sectors that another pillar asks about.
    """
    return (
        F.when(exception.rlike("(?i)government data") & F.coalesce(government_only, F.lit(False)), "government data")
        .when(exception.rlike("(?i)(?:covered|captured) under Pillar") & F.coalesce(sector.rlike(elsewhere), F.lit(False)), "asked in its own pillar")
        .when(exception.isNotNull() & F.coalesce(within, F.lit(False)) & (F.coalesce(target, F.lit("")) != ""), "within the stated exception")
    )


def may_govern(instruments: DataFrame, was_read: str = "was_read", kind: str = "kind") -> DataFrame:
    """Instruments that were read and are no publication; unknown is no."""
    return instruments.where(F.coalesce(F.col(was_read), F.lit(False)) & (F.col(kind) != "publication"))


def read_in_full(readings: DataFrame, failure: str = "failure", unreadable: str = "unreadable") -> DataFrame:
    """Readings that did not fail and of whose answer no item was unreadable."""
    return readings.where(F.col(failure).isNull() & (F.coalesce(F.col(unreadable), F.lit(0)) == 0))
