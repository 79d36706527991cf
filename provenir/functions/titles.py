"""Titles of instruments: which link texts are titles, of what kind, and which only speak about the law."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .language import bound

# Nouns that name an instrument, those that name guidance, what may stand behind the noun.
NOUN = (
    r"(?:act|ordinance|enactment|regulations?|rules?|order|by-?laws?|notice|notification|determination|directive|circular|code of practice|code|standard|specification|technical reference"
    r"|information paper|policy document|practice direction|advisory guidelines?|guidelines?|guidebook|guide|manual)"
)
GUIDANCE = r"(?:code of practice|codes of practice|technical reference|information paper|policy document|practice direction|advisory guidelines?|guidelines?|guide|standard)"
TAIL = r"(?i)(?:[\s,–-]*(?:\(\s*(?:act|no)\.?\s*[A-Z]*\s*[0-9]+[\w/]*\s*\)|no\.?\s*[A-Z]*\s*[0-9]+[\w/]*|\(\s*[A-Z][\w/&.\- ]{1,34}\)|[0-9]{4}(?:\s*[–-]\s*[0-9]{4})?|compilation|consolidated|revised|reprint|edition))+$"
# Words of what is published about the law, how it opens, what headlines say, pages that point elsewhere or keep house.
ABOUT = (
    r"(?i)\b(?:press release|media release|speech|newsroom|public consultation|consultation paper|response to|feedback on|factsheet|infographic|annual report|vacancy|tender|quotation|webinar|seminar|conference"
    r"|overview of|introduction to|guide to using|how to|apply for|application form|frequently asked|now available)\b"
)
OPENS = r"(?i)^(?:understand(?:ing)?|enforcement of|amendments? to|updates? to|changes to|about|using|meet|from|annex|know|read|learn|explore|find|see|check|manage|protect|discover|get)\b"
HEADLINE = r"(?i)\b(?:launch(?:es|ed)|publish(?:es|ed)|update[sd]|announce[sd]?|conclude[sd]|strengthen(?:s|ing)|pioneer(?:s|ing)|driv(?:es|ing)|seek[s]? feedback|comes? into force|take[s]? effect|review(?:s|ing|ed))\b"
POINTS = r"(?i)^(?:click|download|view|tap|follow|here|this|these)\b"
HOUSEKEEPING = (
    r"(?i)\b(?:setup guide|user guide|installation|quick start|troubleshooting|service disruption|system maintenance|service interruption|scheduled maintenance|web recruitment|travellers? guide|site map"
    r"|copyright notice|privacy notice|privacy polic(?:y|ies)|cookie polic(?:y|ies)|terms of use|disclaimer)\b"
)
SELF = r"(?i)\b(?:overview|introduction|outline|summary) of (?:(?:this|these|the following)\b|the \b(?:part|division|subdivision|chapter|schedule|clause|paragraph)\b)"
#: Lengths of a title, rounds in which tails are taken off, the least that they leave.
SHORTEST, LONGEST, ROUNDS, LEFT = 10, 170, 3, 6
#: Words of each kind, the first that stands in a title counts; else it is a guideline.
KINDS = (("act", r"\b(?:act|ordinance|enactment)\b"), ("regulation", r"\bregulations?\b"), ("rule", r"\b(?:rules?|by-?laws?)\b"), ("order", r"\border\b"), ("notice", r"\b(?:notice|notification|determination|directive|circular)\b"))


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def published_about(name: Column) -> Column:
    """Whether a name is that of something published about the law."""
    t = _plain(name)
    return t.rlike(ABOUT) | t.rlike(OPENS) | t.rlike(HEADLINE)


def opens_about(opening: Column) -> Column:
    """Whether a document's first words are those of something about the law; an Act's outline of itself is not."""
    return F.trim(F.regexp_replace(_plain(opening), SELF, " ")).rlike(ABOUT)


def kind_of(title: Column) -> Column:
    """The kind that a title's words say, the weightiest first."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(*[F.when(t.rlike(p), kind) for kind, p in KINDS], F.lit("guideline"))


def stem(title: Column) -> Column:
    """A title without numbers, years, short names and editions behind its noun."""
    t = F.trim(title)
    for _ in range(ROUNDS):
        shorter = F.trim(F.regexp_replace(t, TAIL, ""))
        t = F.when(F.char_length(shorter) >= LEFT, shorter).otherwise(t)
    return t


def title_kind(text: Column, also: list[str] | None = None) -> Column:
    """The kind of the instrument that a link's text is the title of, or null if it is none.

    A title is a phrase of bounded length, no sentence and no headline, whose noun stands at its end
    (or at that of its last bracket), before what guidance is on, or is one of the nouns ``also``
    that a country uses besides.
    """

    def judged(t: Column) -> Column:
        s = stem(t)
        ends = rf"(?i)\b{NOUN}$"
        named = s.rlike(ends) | F.trim(F.regexp_extract(s, r"\(([^()]{6,90})\)$", 1)).rlike(ends) | t.rlike(rf"(?i)^(?:the\s+|draft\s+|revised\s+|proposed\s+)*(?:[A-Z][\w'-]*\s+){{0,3}}{GUIDANCE}\s+(?:on|for|of)\b")
        for noun in also or []:
            named = named | s.rlike(rf"(?i)\b\Q{noun}\Es?$") | t.rlike(rf"(?i)^(?:the\s+)?(?:[\w.'-]+\s+){{0,3}}\Q{noun}\Es?\s+(?:on|for|of)\b")
        sentence = t.rlike(r"[.?!]$") | t.rlike(r",\s*\w+\s+\w+\s+\w+\s+\w+\s+\w+")
        possible = F.char_length(t).between(SHORTEST, LONGEST) & ~published_about(t) & ~t.rlike(POINTS) & ~t.rlike(HOUSEKEEPING) & ~sentence
        return F.when(possible & named, kind_of(t))

    return bound(_plain(text), judged)


def registered_kind(claimed: Column, number: Column, status: Column, basis: Column) -> Column:
    """An Act without a number, a standing or a declared type is a publication."""
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when((claimed == "act") & ~(said(number) | (said(status) & (status != "unknown")) | said(basis)), "publication").otherwise(claimed)
