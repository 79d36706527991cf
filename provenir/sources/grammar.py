"""The line grammar of provisions, parsed over blocks of lines instead of whole documents.

What a line is depends on what is open above it, so the grammar is a finite-state scan. Each block
of lines is read as a function from the state before it to the state behind it; functions are
composed in order to give every block the state that it starts in, and then all blocks are cut at
once. Of a document's lines nothing but a sign for each travels through that, and its text is
shuffled once, in blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.indicator import written

#: Lines of a block.
BLOCK = 4096
#: Characters of pieces that a worker holds before they leave.
HELD = 1 << 20
# The lines that open a part, a schedule, a caption, a long title, the enacting words, and numbered provisions.
PART_LINE, PART_SPLIT = r"^\s*(?:PART\s+[IVXLC0-9]+[A-Z]?\b.*|Part\s+[0-9]+[A-Z]?\b.*)$", r"(?i)^PART(?:[IVXLC]+|[0-9]+)[A-Z]?$"
SCHEDULE = (
    r"(?i)^(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH)?(?:SCHEDULE|JADUAL)"
    r"(?:PERTAMA|KEDUA|KETIGA|KEEMPAT|KELIMA|KEENAM|KETUJUH|KELAPAN|KESEMBILAN|KESEPULUH|[IVXLC]+|[0-9]+[A-Z]?|[A-Z])?$"
)
CAPTION, BRACKETS = r"(?i)^\((?![0-9ivxlc]+\)$)[^()]{8,}\)$", r"^\[[^\]]*\]$"
LONG_TITLE, ENACTING = r"(?i)^An Act to\b", r"(?i)^ENACTED by\b"
DEEP, DECIMAL, NUMBERED = r"^\s*[‘'\"]?([0-9]{1,3}(?:\.[0-9]{1,3}){2,}[A-Z]{0,2})\.?(?:\s+(?=\S)|\s*$)", r"^\s*[‘'\"]?([0-9]+\.[0-9]+[A-Z]{0,2})(?:\s+(?=\S)|\s*$)", r"^\s*([0-9]+[A-Z]{0,2})\.(?![0-9])\s*(?:—|-|–)?\s*(?:\(1\))?\s*(?=\S)"
TARIFF = r"^[0-9]{4}\.[0-9]{2}(?:\.[0-9]{2})*$"
#: Lengths under which a line can be a part's number or a schedule's name, a part's title, a part's line.
SHORT, TITLE, LONG = 40, 80, 120

#: Signs of lines: Part number alone, part's line, schedule, caption, brackets, long title, enacting words, numbered provision, capitals, other.
SIGNS = "PQSKBLENCX"
#: What is open (nothing yet, a heading, a long title, a section, loose prose) and what may follow (nothing, a part's title, a caption).
OPEN, NEXT = "ZHTOR", "-tc"
STATES = ["".join(s) for s in itertools.product(OPEN, NEXT)]


def _step(state: str, sign: str) -> tuple[str, str]:
    """(state behind the line, what the line does): heading, part of a heading, or the kind of section it opens, or "" for a line of what is open."""
    opened, follows = state
    if sign == "P":
        return "Ht", "heading"
    if sign == "S":
        return "Oc", "schedule"
    if follows == "c" and sign == "K":
        return opened + "-", ""
    if follows == "c" and sign != "B":
        follows = "-"
    if sign == "Q":
        return "H-", "heading"
    if follows == "t" and sign == "C":
        return "Ht", ""
    follows = "-" if follows == "t" else follows
    if sign == "L":
        return "T" + follows, "long title"
    if opened == "T" and sign == "E":
        return "R" + follows, "prose"
    if sign == "N":
        return "O" + follows, "provision"
    if opened in "ZH":
        return "R" + follows, "prose"
    return opened + follows, ""


#: The table of the grammar: state and sign to state and action.
TABLE = {(s, c): _step(s, c) for s in STATES for c in SIGNS}
_NEXT = {c: [STATES.index(TABLE[s, c][0]) for s in STATES] for c in SIGNS}


def number(line: Column) -> Column:
    """The number of a provision that opens on a line; empty if none does. Tariff codes are no provisions."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (DEEP, DECIMAL, NUMBERED)], F.lit(""))
    return F.when(found.rlike(TARIFF), "").otherwise(found)


def sign(line: Column, following: Column) -> Column:
    """The sign of a line; a schedule's name above a provision's number is a marginal note."""
    short = F.char_length(line) < SHORT
    packed = F.regexp_replace(line, r"\s+", "")
    schedule = short & F.exists(F.split(packed, "/"), lambda half: half.rlike(SCHEDULE)) & (number(F.coalesce(following, F.lit(""))) == "")
    letters = F.regexp_replace(line, "[^A-Za-z]", "")
    capitals = (F.char_length(line) < TITLE) & (F.char_length(letters) >= 3) & (letters == F.upper(letters))
    trimmed = F.trim(line)
    return (
        F.when(short & packed.rlike(PART_SPLIT), "P").when(schedule, "S").when(line.rlike(PART_LINE) & (F.char_length(line) < LONG), "Q").when(line.rlike(LONG_TITLE), "L")
        .when(number(line) != "", "N").when(trimmed.rlike(CAPTION), "K").when(trimmed.rlike(BRACKETS), "B").when(line.rlike(ENACTING), "E").when(capitals, "C").otherwise("X")
    )


def _composed(signs: str) -> list[int]:
    """A block's function from state to state; once all states have met, one is walked for all."""
    now = list(range(len(STATES)))
    for i, c in enumerate(signs):
        now = [_NEXT[c][s] for s in now]
        if len(set(now)) == 1:
            s = now[0]
            for d in signs[i + 1 :]:
                s = _NEXT[d][s]
            return [s] * len(STATES)
    return now


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, section, kind, label, heading_path, start, text): the documents cut at the lines that open something.

    Kinds: heading (a part with its title), schedule, long title, provision (``label``: its number)
    and prose (what stands in none). ``heading_path`` is the heading above, or empty. ``start``
    counts characters; the texts of a document's sections, joined by line ends, are its text. Null
    texts count as empty, and an empty text is one section of prose; rows of one id must be one.
    """
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)
    blocks = F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / block).cast("int"))
    cut = F.transform(blocks, lambda b: F.struct(b.alias("block"), F.slice("_lines", b * block + 1, block).alias("lines"), F.get("_lines", ((b + 1) * block).cast("int")).alias("after")))
    rows = docs.select(F.col(id_col).alias("id"), lines.alias("_lines")).select("id", F.explode(cut).alias("_b")).select("id", "_b.*").repartition("id", "block")
    read = F.transform("lines", lambda line, i: sign(line, F.coalesce(F.get("lines", i + 1), F.col("after"))))
    signed = written(rows.select("id", "block", "lines", F.array_join(read, "").alias("signs"), (F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.char_length(x) + 1)).alias("size")))

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = pa.array((_composed(x.as_py()) for x in batch.column(3)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], step], ["id", "block", "size", "step"])

    kind = docs.schema[id_col].dataType.simpleString()
    steps = signed.select("id", "block", "size", "signs").mapInArrow(functions, f"id {kind}, block int, size long, step array<int>")
    # a row for each block: fifteen numbers, composed in order
    start = F.struct(F.array().cast("array<struct<block:int,state:int,start:bigint>>").alias("out"), F.lit(0).alias("state"), F.lit(0).cast("long").alias("at"))
    whole = F.aggregate(
        F.array_sort(F.collect_list(F.struct("block", "size", "step"))),
        start,
        lambda a, b: F.struct(F.concat(a["out"], F.array(F.struct(b["block"].alias("block"), a["state"].alias("state"), a["at"].alias("start")))).alias("out"), F.get(b["step"], a["state"]).alias("state"), (a["at"] + b["size"]).alias("at")),
        lambda a: a["out"],
    )
    entries = steps.groupBy("id").agg(whole.alias("_w")).select("id", F.explode("_w").alias("_e")).select("id", "_e.*")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "block", "start", "kind", "text"]
        for batch in batches:

            def leave(out: list[tuple], batch=batch) -> pa.RecordBatch:
                row, begun, opens, text = zip(*out)
                own = pa.array(row, pa.int32())
                return pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(begun, pa.int64()), pa.array(opens, pa.string()), pa.array(text, pa.string())], names)

            # block by block; pieces leave in small batches, so that what is held besides the input is bounded
            out, held = [], 0
            for row in range(batch.num_rows):
                own_lines, signs, state, at = (batch.column(c)[row].as_py() for c in range(2, 6))
                s, first, opens, begun = STATES[state], 0, "", at
                for i, c in enumerate(signs):
                    s, action = TABLE[s, c]
                    if action:
                        if i > first:
                            out.append((row, begun, opens, "\n".join(own_lines[first:i])))
                        first, opens, begun = i, action, at
                    at += len(own_lines[i]) + 1
                out.append((row, begun, opens, "\n".join(own_lines[first:])))
                held += sum(map(len, own_lines)) + 1
                if held > HELD or len(out) > HELD >> 8:
                    yield leave(out)
                    out, held = [], 0
            if out:
                yield leave(out)

    cut_up = signed.join(entries, ["id", "block"]).select("id", "block", "lines", "signs", "state", "start").mapInArrow(pieces, f"id {kind}, block int, start long, kind string, text string")
    nth = F.count_if(F.col("kind") != "").over(Window.partitionBy("id").orderBy("start"))
    whole_sections = cut_up.withColumn("section", nth).groupBy("id", "section").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["text"]), "\n")
    found = whole_sections.select("id", "section", F.col("_p")[0]["kind"].alias("kind"), F.col("_p")[0]["start"].alias("start"), text.alias("text"))
    above = F.last(F.when(F.col("kind") == "heading", F.regexp_replace("text", r"\s*\n\s*", " ")).when(F.col("kind") == "schedule", F.split_part("text", F.lit("\n"), F.lit(1))).when(F.col("kind") == "long title", ""), ignorenulls=True).over(Window.partitionBy("id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1))
    label = F.when(F.col("kind") == "provision", number(F.split_part("text", F.lit("\n"), F.lit(1))))
    return found.select(F.col("id").alias(id_col), "section", "kind", label.alias("label"), F.coalesce(above, F.lit("")).alias("heading_path"), "start", "text")
