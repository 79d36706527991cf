"""Text functions as column expressions: folds, tokens, normalisers, language, dates, money, titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic signs that quotes are compared without.
CURLY, STRAIGHT = "‘’‚‛“”„‟‐‑‒–—− ", "''''\"\"\"\"------ "


def quote_key(c: Column) -> Column:
    """Quotes and dashes straightened, white space single, lower case, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, CURLY, STRAIGHT)), r"[\s]+", " "))


def tokens(c: Column, least: int = 3) -> Column:
    """Lower-case words of letters and digits with at least ``least`` characters, in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}\p{M}]+"), lambda w: F.char_length(w) >= least)


def stems(c: Column, length: int = 5) -> Column:
    return F.array_distinct(F.transform(tokens(c), lambda w: F.substring(w, 1, length)))


def title_key(c: Column) -> Column:
    """Letters and digits only, single blanks, without a leading article."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), "^(the|a|an) ", "")


def url_key(c: Column) -> Column:
    """Without scheme, www., query, fragment and closing slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"^https?://(www\.)?", ""), r"[?#].*$", ""), r"/+$", "")


def host(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"^[a-z]+://([^/?#:]+)", 1)


def money(c: Column) -> Column:
    """The first amount with a currency sign or code, in units, or null."""
    found = F.regexp_extract(c, r"(?:USD|EUR|\$|€)\s?([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.when(found != "", F.regexp_replace(found, ",", "").cast("double"))


def any_date(c: Column) -> Column:
    """The date in the first of several notations that fits, or null."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.try_to_timestamp(c, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy", "d MMMM yyyy")])


def clipped(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut behind a word."""
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.regexp_extract(F.substring(c, 1, most - 2), r"^(?s)(.*)\s", 1), F.lit(" …")))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
