"""Sums of money in wordings: digits of any script, worded sums, three ways to group thousands.

A wording is read in three steps: its digits become those of ASCII, its worded sums become figures,
and one pattern finds every figure with the currency that stands at it. Only wordings that can
state a sum (a digit or a number word) reach this grammar; the rest are told apart by a column
expression.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

# The currency of each economy's bare signs, and the names of currencies, longer ones first.
HOME = {"AUS": "AUD", "SGP": "SGD", "MYS": "MYR", "IND": "INR", "THA": "THB", "IDN": "IDR", "CHN": "CNY"}
NAMED = {
    "USD": r"\bUS\s?\$|\bUSD\b|\bUS dollars?\b",
    "AUD": r"\bA\s?\$|\bAUD\b|\bAustralian dollars?\b",
    "SGD": r"\bS\s?\$|\bSGD\b|\bSingapore dollars?\b",
    "MYR": r"\bRM(?=\s?\d)|\bMYR\b|\bringgit\b",
    "INR": r"₹(?=\s?\d)|\bINR\b|\bIndian rupees?\b|\brupees?\b",
    "THB": r"\bTHB\b|\bbaht\b|บาท",
    "IDR": r"\bIDR\b|\bRp(?=\s?\d)|\brupiah\b",
    "CNY": r"\bCNY\b|\bRMB\b|\byuan\b|\brenminbi\b",
}
# Number words and scales.
ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"million": 1_000_000, "thousand": 1000, "hundred": 100}
# Words before a figure that make it a citation, and what behind it makes it no sum.
CITED = r"\b(?:sections?|ss?|articles?|art|regulations?|regs?|rules?|paragraphs?|paras?|items?|clauses?|parts?|chapters?|schedules?|subsections?|divisions?|forms?|no)\.?\s*$"
NO_SUM = r"\s?(?:%|per\s?cent|percent|days?|weeks?|months?|years?|hours?|minutes?|[a-z]\b|\()"

_VALUE = {w: i + 1 for i, w in enumerate(ONES)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
_WORD = "(?:" + "|".join([*sorted(_VALUE, key=len, reverse=True), *SCALES]) + ")"
_PEOPLE = r"(?:US|Australian|Singapore|Indian)"
_WORDED = re.compile(rf"\b({_WORD}(?:(?:\s+and\s+|[\s-]+){_WORD})*)(?=\s+(?:{_PEOPLE}\s+)?(?:dollars?|ringgit|rupees?|baht|rupiah|yuan)\b)", re.I)
_GAP = "[    ]"
_FIGURE = rf"[0-9]{{1,2}}(?:,[0-9]{{2}})+,[0-9]{{3}}(?:\.[0-9]+)?(?![0-9])|[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?|[0-9]{{1,3}}(?:{_GAP}[0-9]{{3}})+(?![0-9,])(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?"
_BEFORE = re.compile(r"(US\s?\$|A\s?\$|S\s?\$|RM|₹|Rp|\$|\b(?:USD|AUD|SGD|MYR|INR|THB|IDR|CNY|RMB))\s?$", re.A)
_AFTER = re.compile(rf"\s?((?:{_PEOPLE}\s+)?(?:dollars?|ringgit|rupees?|baht|rupiah|yuan|renminbi|USD|AUD|SGD|MYR|INR|THB|IDR|CNY|RMB)\b|บาท)", re.I | re.A)
_SUMS, _CITED, _NO_SUM = re.compile(_FIGURE), re.compile(CITED, re.I | re.A), re.compile(NO_SUM, re.I | re.A)
_NAMES = [(c, re.compile(p, re.I | re.A)) for c, p in NAMED.items()]
#: Characters before and behind a figure that are looked at.
LEFT, RIGHT = 24, 32


class Money(NamedTuple):
    amount: float
    currency: str
    assumed: bool


def worded(run: str) -> int:
    """The value of number words: what stands before a scale counts that many times, what stands behind is added."""

    def value(words: list[str], scales: list[tuple[str, int]]) -> int:
        if not scales:
            return sum(map(_VALUE.__getitem__, words))
        (name, size), *rest = scales
        if name not in words:
            return value(words, rest)
        at = len(words) - 1 - words[::-1].index(name)
        return (value(words[:at], scales) or 1) * size + value(words[at + 1 :], rest)

    return value([w for w in re.split(r"[\s-]+", run.lower()) if w != "and"], list(SCALES.items()))


def figures(text: str) -> str:
    """The wording with digits of ASCII and worded sums as figures."""
    plain = "".join(str(unicodedata.digit(c)) if c.isdecimal() and not c.isascii() else c for c in text)
    return _WORDED.sub(lambda m: str(worded(m[1])), plain)


def stated(written: str | None, economy: str | None = None) -> Money | None:
    """The one sum of money that a wording states, or None if it states none or two different ones.

    A figure at a currency counts; a bare sign is the economy's own currency, which is then assumed.
    Without any figure at a currency a single bare one counts, if it is no citation, year, share,
    duration or part of an enumeration, in the currency that the wording names or the economy's.
    """
    text, home = figures(written or ""), HOME.get((economy or "").upper())
    at_currency: set[Money] = set()
    bare: set[float] = set()
    for m in _SUMS.finditer(text):
        before, after = text[max(0, m.start() - LEFT) : m.start()], text[m.end() : m.end() + RIGHT]
        sign, name = _BEFORE.search(before), _AFTER.match(after)
        if sign is None and re.search("[A-Za-z]$", before):
            continue
        amount = float(re.sub(f",|{_GAP}", "", m[0]))
        if sign or name:
            own = f"{sign[1]}{m[0]}" if sign else f"{m[0]} {name[1]}"
            currency = next((c for c, p in _NAMES if p.search(own) or sign and p.search(sign[1])), None)  # a sign counts at a figure, a code on its own
            if currency or home and re.fullmatch(r"\$|dollars?", (sign or name)[1].strip(), re.I):
                at_currency.add(Money(amount, currency or home, currency is None))
        elif not (_CITED.search(before) or before.endswith("(") or _NO_SUM.match(after) or re.fullmatch("(?:19|20)[0-9]{2}", m[0])):
            bare.add(amount)
    if at_currency:
        distinct = {(x.amount, x.currency) for x in at_currency}
        return min(at_currency, key=lambda x: x.assumed) if len(distinct) == 1 else None
    named = next((c for c, p in _NAMES if p.search(text)), None)
    return Money(bare.pop(), named or home, named is None) if len(bare) == 1 and (named or home) else None


_MONEY = StructType([StructField("amount", DoubleType()), StructField("currency", StringType()), StructField("assumed", BooleanType())])


@F.pandas_udf(_MONEY)
def _stated(text: pd.Series, economy: pd.Series) -> pd.DataFrame:
    found = [stated(t, e) or (None, None, None) for t, e in zip(text, economy)]
    return pd.DataFrame(found, columns=["amount", "currency", "assumed"])


def money(text: Column, economy: Column | None = None) -> Column:
    """struct(amount, currency, assumed): the one sum that a wording states; fields are null if there is none."""
    can = F.coalesce(text.rlike(r"(?i)\p{Nd}|\b" + _WORD + r"\s"), F.lit(False))
    return _stated(F.when(can, text), F.lit(None).cast("string") if economy is None else economy)
