"""Approximate substrings: folded texts with their places, a bit-parallel edit automaton, near quotes.

The automaton keeps a row of the edit table as two bit vectors (where it rises and where it falls
by one), so a character of the text costs a few operations on machine words whatever the pattern's
length. Long texts are not walked whole: a pattern with k edits is cut into k + 1 pieces, one of
which stands in every hit as it is.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

# Signs that are set around words and not spoken, apostrophes and dashes that count as one, Lao AM and its halves.
UNSPOKEN, APOSTROPHES, DASHES, LAO_AM, LAO_HALVES = '*"“”„‟″«»', "‘’‚‛′", "‐‑‒–—―−", "ຳ", "ໍາ"
#: A near quote's least length, the part of it that must match, how far it may stretch, the length of its seeds.
NEAR_LEAST, NEAR_MATCH, NEAR_STRETCH, SEED = 20, 0.92, 1.35, 8
#: The least of a fragment, and of one that may have slips; so many characters allow one more slip.
FRAGMENT, ANCHOR, PER_SLIP = 3, 12, 20
#: So many diagonals of a near quote are aligned at least (ties included), and all with this share of the most votes.
DIAGONALS, VOTES = 8, 0.5


def folded(text: str) -> tuple[str, list[int]]:
    """The text as quotes are compared, and for each of its characters the place that it came from.

    Signs that are not spoken go, apostrophes and dashes count as one, white space is single, case
    does not count; a blank goes between Lao letters and before a mark that sits on a Thai letter.
    """
    out: list[str] = []
    places: list[int] = []
    blank = -1  # place of white space that is still to be written
    for at, c in enumerate(text):
        if c in UNSPOKEN:
            continue
        if c.isspace():
            blank = at if blank < 0 else blank
            continue
        if blank >= 0:
            last = out[-1] if out else ""
            joined = "຀" <= last <= "໿" and "຀" <= c <= "໿" or "฀" <= last <= "๿" and (c == "ั" or "ิ" <= c <= "ฺ" or "็" <= c <= "๎")
            if not joined and out:
                out.append(" ")
                places.append(blank)
            blank = -1
        for f in "'" if c in APOSTROPHES else "-" if c in DASHES else LAO_HALVES if c == LAO_AM else c.lower():
            out.append(f)
            places.append(at)
    return "".join(out), places


def edits_within(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end): the fewest edits that turn ``pattern`` into a part of ``text``, if at most ``most``, and where the first such part ends."""
    m = len(pattern)
    if m <= most:
        return (m, 0) if m else (0, 0)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    rises, falls, edits, best = full, 0, m, None
    for at, c in enumerate(text):
        equal = where.get(c, 0)
        diagonal = (((equal & rises) + rises) ^ rises) | equal | falls
        up, down = falls | ~(diagonal | rises) & full, rises & diagonal
        edits += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full  # a hit may begin anywhere, so nothing is carried in
        rises, falls = down | ~(diagonal | up) & full, up & diagonal
        if edits <= most and (best is None or edits < best[0]):
            best = (edits, at + 1)
            if not edits:
                break
    return best


def pieces(pattern: str, most: int) -> list[tuple[int, str]]:
    """(offset, piece): the pattern in ``most`` + 1 pieces; a hit with that many edits holds one of them unchanged."""
    cuts = [len(pattern) * i // (most + 1) for i in range(most + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def approximate_span(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best part of a text within ``most`` edits of a pattern: fewest edits, then the first end, then the shortest part."""
    found = edits_within(pattern, text, most)
    if found is None:
        return None
    edits, end = found
    back = edits_within(pattern[::-1], text[:end][::-1], edits)
    return end - back[1], end, edits


def without_stutter(phrase: str) -> list[str]:
    """The phrase with each run of up to three characters that is written twice at once written once."""
    return [phrase[:i] + phrase[i + n :] for n in (1, 2, 3) for i in range(len(phrase) - 2 * n + 1) if phrase[i : i + n] == phrase[i + n : i + 2 * n]]


def copied(act: str | None, quote: str | None) -> bool:
    """Whether every fragment of an act stands in a quote: as it is, or, if it is long, with a slip for each twenty characters."""
    text, _ = folded(unicodedata.normalize("NFC", quote or ""))
    parts = [p for p in (folded(unicodedata.normalize("NFC", p))[0].strip() for p in (act or "").replace("…", "...").split("...")) if p]

    def held(p: str) -> bool:
        slips = max(1, len(p) // PER_SLIP)
        return len(p) >= FRAGMENT and (p in text or len(p) >= ANCHOR and any(edits_within(v, text, slips) is not None for v in (p, *without_stutter(p))))

    return bool(parts) and all(map(held, parts))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _cheapest(quote: np.ndarray, window: np.ndarray, fixed_start: bool) -> tuple[int, int, int]:
    """(end, edits, matched) of the alignment with the fewest edits and, among those, the most equal characters."""
    edit = len(quote) + 1  # outweighs all equal characters together
    place = np.arange(len(window) + 1, dtype=np.int64) * edit
    row = place.copy() if fixed_start else np.zeros(len(window) + 1, np.int64)
    for c in quote:
        step = np.minimum(row[:-1] + np.where(window == c, -1, edit), row[1:] + edit)
        row = np.minimum.accumulate(np.concatenate([[row[0] + edit], step]) - place) + place
    end = int(row.argmin())
    edits = -(-int(row[end]) // edit)
    return end, edits, edits * edit - int(row[end])


def near(text: str | None, quote: str | None, any_script: bool = False) -> tuple[int, int] | None:
    """Where nearly all of a quote stands in a text: (start, end) in characters of the text, or None.

    Every seed of the quote votes for the diagonals on which it stands in the text; the diagonals
    with the most votes are aligned, each in a band as wide as a hit may stretch. Of the alignments
    that match 0.92 of the quote and stretch to 1.35 of it at most, the one that matches most counts,
    then that with the fewest edits (other copies may hold more words), then that with the fewest
    differences when case and signs count too, then the first.
    Only quotes in Cyrillic or Lao are looked for, unless ``any_script``.
    """
    q, _ = folded(quote or "")
    q = q.strip()
    other, latin = sum("Ѐ" <= c <= "ӿ" or "຀" <= c <= "໿" for c in q), sum("a" <= c <= "z" for c in q)
    if len(q) < NEAR_LEAST or not any_script and other <= latin:
        return None
    low, places = folded(text or "")
    seeds: dict[str, list[int]] = {}
    for i in range(len(q) - SEED + 1):
        if len(q[i : i + SEED].strip()) >= SEED - 1:
            seeds.setdefault(q[i : i + SEED], []).append(i)
    reach = int(np.ceil(len(q) * (NEAR_STRETCH - 1))) + SEED
    votes: Counter = Counter()
    for at in range(len(low) - SEED + 1):
        for i in seeds.get(low[at : at + SEED], ()):
            votes[(at - i) // reach] += 1
    most = sorted(votes.values(), reverse=True)[:DIAGONALS]
    best: tuple[tuple[int, int, int], int, int] | None = None
    for band in sorted(b for b, n in votes.items() if n >= min(most[-1], VOTES * most[0])):
        first = max(0, band * reach - reach)
        window = _points(low[first : (band + 1) * reach + len(q) + reach])
        end, edits, matched = _cheapest(_points(q), window, False)
        if matched < NEAR_MATCH * len(q) or best is not None and (-matched, edits) > best[0][:2]:
            continue
        back, _, _ = _cheapest(_points(q)[::-1], window[:end][::-1], True)
        if 0 < back <= NEAR_STRETCH * len(q):
            start, stop = places[first + end - back], places[first + end - 1] + 1
            rank = (-matched, edits, _cheapest(_points(quote), _points(text[start:stop]), True)[1])
            best = (rank, start, stop) if best is None or rank < best[0] else best
    return best and best[1:]


_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


def _spans(texts: pd.Series, quotes: pd.Series, any_script: bool) -> pd.DataFrame:
    found = [near(t, q, any_script) or (None, None) for t, q in zip(texts, quotes)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")


@F.pandas_udf(_SPAN)
def near_span(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """``near`` for quotes in Cyrillic or Lao."""
    return _spans(text, quote, False)


@F.pandas_udf(_SPAN)
def near_span_any(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """``near`` whatever the script."""
    return _spans(text, quote, True)


@F.pandas_udf(BooleanType())
def copied_from(act: pd.Series, quote: pd.Series) -> pd.Series:
    """``copied`` for columns."""
    return pd.Series([copied(a, q) for a, q in zip(act, quote)], dtype="boolean")
