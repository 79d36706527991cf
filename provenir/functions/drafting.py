"""What the drafting of a provision says of it: amendments, definitions, powers, figures left open, force."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .language import bound

# The wordings of amendments, definition entries and their ends, figures left open, what ends a sentence, text that is set out, force.
AMENDED = r"(?i)\b(?:principal|the)\s+Act\s+is\s+amended\b|\bis\s+amended\s+by\s+(?:inserting|substituting|deleting|omitting)\b|\bAmendment\s+of\s+section\b"
ENTRY, ENTRY_END = r"(?i)[\"“][^\"”]{1,90}[\"”]\s{0,4}(?:means|includes|has the (?:same )?meaning)", r"(?:[;.]\s*\n|\n\s*\n)(?!\s*\([a-z]{1,4}\))"
REPLACEABLE = r"(?i)\bor\s+(?:such\s+)?(?:other|another|a\s+different)\s+(?:amount|sum|value|figure)\s+(?:as\s+)?(?:is|may\s+be|that\s+is)\s+(?:prescribed|specified|determined)\b"
MODAL, SENTENCE_END = r"\b(?:must not|shall not|may not|must|shall|may)\b", r"[.;]\s+(?=[A-Z(])|\n\s*\n"
SET_OUT = r"(?i)\b(?:inserting|substituting|adding|inserted|substituted)\b[^:\"“]{0,160}[:,]?\s*[\"“]"
BINDS = (
    r"(?i)\bdenotes\s+a\s+standard,\s+an\s+obligation,\s+a\s+requirement\b",
    r"(?i)\bnon-?compliance\s+(?:with\s+[^.]{0,60}?)?may\s+result\s+in\s+enforcement\s+action\b",
    r"(?i)\blicensees?\s+(?:shall|must)\s+comply\s+with\s+(?:any|all|the)\s+guidelines\s+issued\b",
)
BINDS_NOT = r"(?i)\b(?:not\s+legally\s+binding|do(?:es)?\s+not\s+have\s+the\s+force\s+of\s+law|will\s+not\s+(?:of\s+itself\s+)?attract\s+(?:criminal\s+)?(?:liability|penalt))"
_NAME = r"([A-Z][A-Za-z'()’-]*(?:\s+[A-Za-z'()&’-]+){0,12}?\s+(?:Act|Ordinance|Enactment|Regulations?|Rules?|Orders?)(?:\s+[0-9]{4})?)\s*\[\s*([^\]]{2,40}?)\s*\]"
AMENDS_WHAT = (rf"(?i){_NAME}\s*,?\s*(?:which\s+is\s+)?referred\s+to\s+as\s+the\s+[\"“]?principal", rf"(?i)\b(?:to\s+amend|amendment\s+of)\s+(?:the\s+)?{_NAME}", rf"(?i){_NAME}\s+(?:is|are)\s+amended\b")
#: Characters in which an amendment shows, words of a quote, how soon behind a figure it is left open, sections that state force, their head.
HEAD, LEAST, SOON, CLAUSE = 400, 3, 20, 1600


def _flat(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")


def _stand(text: Column, words: Column, found) -> Column:
    """Whether ``found`` holds of what stands before some words, at any of their places; false if they are not there, or too few."""
    own, text = F.trim(words), F.coalesce(text, F.lit(""))
    first = F.instr(text, own)
    again = F.instr(F.substring(text, first + 1, F.char_length(text)), own) > 0
    # a piece begins at each place, overlapping ones too; the first piece holds the text's beginning
    at = F.concat(F.lit("(?=\\Q"), F.replace(own, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    heads = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ""))
    head = F.when((F.char_length(own) >= LEAST) & (first > 0), F.substring(text, F.lit(1), first - 1))
    at_first = F.coalesce(bound(head, found), F.lit(False))
    # only words that stand in several places are looked for again
    return F.when(at_first, True).when(F.coalesce((F.char_length(own) >= LEAST) & (first > 0) & again, F.lit(False)), F.exists(heads(F.split(text, at)), found)).otherwise(False)


def amends_another(text: Column) -> Column:
    """Whether a provision's beginning amends another Act."""
    return F.coalesce(F.substring(text, 1, HEAD).rlike(AMENDED), F.lit(False))


def cites_definition(text: Column, words: Column) -> Column:
    """Whether some words stand in a definition: behind its entry, before the next one and before the drafting breaks off."""

    def found(head: Column) -> Column:
        # the last entry that opens before the words, and what follows it up to them
        behind = F.regexp_extract(F.regexp_replace(head, f"({ENTRY})", "\u0001$1"), "\u0001([^\u0001]*)$", 1)
        opener = F.regexp_replace(behind, f"^{ENTRY}", "")
        return (behind != "") & ~opener.rlike(ENTRY_END)

    own = F.trim(words)
    # words that begin with their entry stand in it: the entry is let in
    starts = F.coalesce(own.rlike(f"^{ENTRY}") & F.contains(text, own) & (F.char_length(own) >= LEAST), F.lit(False))
    return starts | _stand(text, words, found)


def figure_replaceable(text: Column, words: Column) -> Column:
    """Whether the last figure of some words may be replaced where the provision states it."""
    figure = F.trim(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(words, F.lit(r"[0-9][0-9,.\s]*[0-9]|[0-9]"), F.lit(0))), -1))
    pattern = F.concat(F.lit(r"\Q"), figure, F.lit(r"\E.{0," + str(SOON) + "}?" + REPLACEABLE))
    return F.coalesce((figure != "") & F.call_function("rlike", _flat(text), pattern), F.lit(False))


def inherits_power(text: Column, words: Column) -> Column:
    """Whether some words are an item of a list that a power opens (its stem's last modal is ``may``)."""

    def found(head: Column) -> Column:
        stem = F.element_at(F.split(F.regexp_extract(head, r"^([\s\S]*):[^:]*$", 1), SENTENCE_END), -1)
        modals = F.regexp_extract_all(F.lower(stem), F.lit(MODAL), F.lit(0))
        ended = F.regexp_extract(head, r":([^:]*)$", 1).rlike(r"[.]\s+[A-Z]")
        return head.contains(":") & ~ended & (F.size(modals) > 0) & (F.element_at(F.concat(F.array(F.lit("")), modals), -1) == "may")

    return _stand(text, words, found)


def inserts_words(text: Column, words: Column) -> Column:
    """Whether some words are text that the provision sets out for another one."""
    return _stand(_flat(text), _flat(words), lambda head: head.rlike(SET_OUT + r"[^\"”]*$"))


def states_force(head: Column) -> Column:
    """Whether an instrument's first sections say that it binds, and none that it does not (``head``: array of texts)."""
    flat = F.transform(head, _flat)
    return F.coalesce(~F.exists(flat, lambda t: t.rlike(BINDS_NOT)) & F.exists(flat, lambda t: t.rlike(BINDS[0]) | t.rlike(BINDS[1]) | t.rlike(BINDS[2])), F.lit(False))


def amends_what(text: Column) -> Column:
    """struct(name, number) of the instrument that a text's beginning says it amends; null if it says none."""

    def first(head: Column) -> Column:
        found = [F.when(head.rlike(p), F.struct(F.trim(F.regexp_replace(F.regexp_extract(head, p, 1), r"(?i)^The\s+", "")).alias("name"), F.trim(F.regexp_extract(head, p, 2)).alias("number"))) for p in AMENDS_WHAT]
        return F.coalesce(*found)

    return bound(F.substring(_flat(text), 1, CLAUSE), first)


def rationale(score: Column, criterion: Column, reason: Column, basis: Column, asked: Column, absence: Column, read: Column, indexed: Column, excluded: Column, exception: Column) -> Column:
    """The rationale of a cell: the quote first, then how it is read; or what was searched and what its nearest instrument does not do.

    ``basis`` is an array of struct(quote, cited, heading), ``absence`` a struct(governing, instrument,
    findings, current_to) or null, ``excluded`` how many measures an ``exception`` takes out.
    """
    lead = F.get(basis, F.lit(0))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    found = F.concat(F.lit('"'), text(lead["quote"]), F.lit('" ('), text(lead["cited"]), F.lit(", "), text(lead["heading"]), F.lit("). Scored "), text(score), F.lit(' -- "'), text(criterion), F.lit('": '), text(reason), F.lit("."))
    governing = F.concat(text(absence["instrument"]), F.lit(" regulates this area -- "), text(absence["findings"]), F.lit(" requirement(s) of this pillar were read in it -- and imposes no "), F.lower(asked), F.lit("."))
    current = F.when(absence["governing"] & absence["current_to"].isNotNull(), F.concat(F.lit("The text read is the published consolidation, current to "), text(absence["current_to"]), F.lit(".")))
    nearest = F.concat(F.lit("No instrument in the corpus was found to regulate this area. The most relevant one the search returned, "), text(absence["instrument"]), F.lit(", imposes no "), F.lower(asked), F.lit("."))
    said = F.concat(F.lit("Scored "), text(score), F.lit(' -- "'), text(criterion), F.lit('". '), F.upper(F.left(text(reason), F.lit(1))), F.substring(text(reason), 2, 1 << 30), F.lit(" across "), text(read), F.lit(" provision(s) read for this indicator, out of "), text(indexed), F.lit(" in the corpus."))
    none = F.concat_ws(" ", F.when(absence.isNotNull(), F.when(absence["governing"], governing).otherwise(nearest)), current, said)
    out = F.when((excluded > 0) & exception.isNotNull(), F.concat(text(excluded), F.lit(" measure(s) were found and not scored: "), F.regexp_replace(exception, r"\.$", ""), F.lit(".")))
    return F.concat_ws(" ", F.when(F.coalesce(F.size(basis), F.lit(0)) > 0, found).otherwise(none), out)
