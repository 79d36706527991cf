"""Findings over the given tables: passages as readings, sources as frameworks, turns as answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.lexicon import pattern, says
from ..functions.provisions import BASE, MEASURES, PROVISIONS
from ..operators import findings as D
from ..operators import rules as R
from .evidence import _passages

KINDS = ("foreign", "place", "information", "frontier", "floor", "duration", "restriction")


@query("n05_wordings", "SELECT doc_id, " + ", ".join(f"regexp_matches(lower(coalesce(text, '')), '{pattern(k)}') AS says_{k}" for k in KINDS) + " FROM documents")
def n05(t):
    """What kinds of words each document holds."""
    return t("documents").select("doc_id", *[says("text", k).alias(f"says_{k}") for k in KINDS])


def _cited(t) -> DataFrame:
    """Passages as readings of the documents that hold them, with what is marked of those."""
    facts = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "source", "lang", "quality", "toxic")
    return _passages(t).join(facts, "doc_id")


_FLAGS = "locational crosses_border appoints proportional foreign_only binds_state may_permit".split()
_ASKED = {**{c: "string" for c in "measure measure_kind defines must_say subject".split()}, **{c: "boolean" for c in _FLAGS}}
_STATED = {**{c: "string" for c in D.WORDINGS if c != "measure"}, "amount": "double", "usd": "double", "proportion": "double", "confirmed": "boolean", "subject_in_instrument": "boolean"}
_MEASURES = [tuple(m.get(c, False if c in _FLAGS else None) for c in _ASKED) for m in MEASURES]
_PLANTED = [(i, *[{**BASE, **said}.get(c) for c in _STATED]) for i, said in enumerate(PROVISIONS)]
#: What a document's first line states as a provision, in both dialects; what is not named is not stated.
_LINE = {
    "language": "lang", "heading": "source", "quote": "line", "instrument_kind": "'act'", "bindingness": "'binding'", "duty_force": "CASE WHEN length(line) > 40 THEN 'requires' ELSE 'declares' END", "duty_bearer": "split_part(line, ' ', 1)",
    "bearer_kind": "'private'", "duty_act": "split_part(line, ' ', 2)", "subject_words": "line", "place_words": "CASE WHEN contains(lower(line), 'licen') THEN line END",
}


def _values(rows: list[tuple], columns: dict[str, str]) -> str:
    """SQL of a few literal rows."""
    shown = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    typed = ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in columns.items())
    return f"SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) v({', '.join(columns)})"


def _says(c: str, kind: str) -> str:
    return f"regexp_matches(lower(coalesce({c}, '')), '{pattern(kind)}')"


def _says_all(kinds: dict[str, str], c: str) -> str:
    return ", ".join(f"{_says(c, kind)} AS {name}" for name, kind in kinds.items())


_GATES_SQL = f"""
WITH planted AS ({_values(_PLANTED, {"number": "bigint", **_STATED})}), measures AS ({_values(_MEASURES, _ASKED)}),
d AS (SELECT doc_id, lang, source, split_part(text, chr(10), 1) AS line FROM documents),
readings AS (
  SELECT doc_id, false AS planted, {", ".join(f"CAST({_LINE.get(c, 'NULL')} AS {k}) AS {c}" for c, k in _STATED.items())} FROM d
  UNION ALL SELECT doc_id, true, {", ".join("concat_ws(chr(10), line, p.quote)" if c == "quote" else f"p.{c}" for c in _STATED)} FROM d LEFT JOIN planted p ON p.number = (doc_id % {len(PROVISIONS)} + {len(PROVISIONS)}) % {len(PROVISIONS)}),
joined AS (SELECT *, concat_ws(' ', quote, defining_words) AS words, concat_ws(' ', duty_bearer, defining_words, subject_words, quote) AS parties FROM readings),
worded AS (SELECT *,
  {_says_all({"set_elsewhere": "elsewhere", "scoped_to_office": "office", "prohibits": "prohibition", "is_decision": "decision", "defines_a_term": "definition", "scoped_to_tender": "tender", "licence_terms": "licence terms", "is_floor": "floor", "for_inspection": "inspection", "empowers": "empowering", "is_pointer": "pointing", "inserts_words": "inserting", "stops_keeping": "cease"}, "quote")},
  {_says_all({"words_name_bank": "bank", "words_restrict": "restriction", "words_name_standard": "standard", "words_electronic": "electronic", "words_excluded_content": "excluded content", "words_eligibility": "eligibility"}, "words")},
  {_says("words", "merger")} AND NOT {_says("words", "foreign")} AS words_merger, {_says("condition_words", "condition")} AS condition_fits, {_says("heading", "outline")} AS is_outline, {_says("parties", "foreign")} AS names_foreign,
  {_says("place_words", "foreign")} OR contains(lower(coalesce(place_words, '')), 'abroad') AS place_abroad, contains(lower(coalesce(quote, '')), 'goods of this class') AS carried_subject,
  {_says("held_words", "foreign")} AND NOT {_says("duty_bearer", "foreign")} AS held_abroad, {_says("condition_words", "place")} AND lower(condition_words) = lower(border_words) AS condition_is_place, {_says("stem", "empowering")} AS inherits_a_power,
  CASE WHEN {_says("concat_ws(' ', located_data, quote)", "information")} THEN located_data END AS information_words, {_says("located_data", "information")} AS information_fits, {_says("place_words", "place")} AS place_is_jurisdiction, {_says("role_words", "data officer")} AS role_fits,
  regexp_matches(lower(coalesce(quote, '')), '(?:^|[^a-z])(?:is|are) amended(?:[^a-z]|$)') AS amends_another_act FROM joined),
judged AS (SELECT *, defines IS NOT NULL AS must_define, coalesce(regexp_matches(lower(defining_words), must_say), must_say IS NULL) AS defining_fits, subject IS NOT NULL AS subject_required,
  coalesce(regexp_matches(lower(subject_words), subject), false) AS subject_fits, coalesce(regexp_matches(lower(heading), subject), false) AS carried_fits FROM worded CROSS JOIN measures),
decided AS (SELECT doc_id, planted, measure, language, CASE {" ".join(f"WHEN {g.condition} THEN '{g.name}'" for g in R.GATES)} END AS gate FROM judged)
SELECT doc_id, planted, measure, gate, CASE WHEN gate IN ({", ".join(f"'{g.name}'" for g in R.GATES if g.outcome == "held")}) OR language IN {R.UNCOVERED} AND gate IN ({", ".join(f"'{g.name}'" for g in R.GATES if g.outcome == "ruled out*")}) THEN 'held' WHEN gate IS NOT NULL THEN 'ruled out' END AS outcome FROM decided"""


@query("g_gates_on_words", _GATES_SQL)
def gates_on_words(t):
    """The gate that decides each document under each measure, read as a provision whose duty is its first line, and again with a provision planted behind that line (all in turn, so that every gate has its words)."""
    spark = t("documents").sparkSession
    planted = spark.createDataFrame(_PLANTED, ", ".join(f"{c} {k}" for c, k in {"number": "long", **_STATED}.items()))
    measures = spark.createDataFrame(_MEASURES, ", ".join(f"{c} {k}" for c, k in _ASKED.items()))
    d = t("documents").select("doc_id", "lang", "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"), F.pmod("doc_id", F.lit(len(PROVISIONS))).cast("long").alias("number"))
    d = d.join(F.broadcast(planted), "number", "left")
    own = [F.expr(_LINE.get(c, "NULL")).cast(k).alias(c) for c, k in _STATED.items()]
    behind = [(F.concat_ws("\n", "line", "quote") if c == "quote" else F.col(c)).alias(c) for c in _STATED]
    both = F.array(F.struct(F.lit(False).alias("planted"), *own), F.struct(F.lit(True).alias("planted"), *behind))
    readings = d.select("doc_id", F.explode(both).alias("r")).select("doc_id", "r.*")
    return R.decided(D.judged(readings, measures)).select("doc_id", "planted", "measure", "gate", "outcome")


@query("v01_rejections", """
SELECT doc_id, item_id, CASE WHEN lang = 'es' THEN 'not asked' WHEN length(b.text) < 12 THEN 'no measure named' WHEN toxic = 1 THEN 'place not in the provision' WHEN quality IS NULL THEN 'reach not stated' END AS rejection
FROM documents d JOIN benchmark b ON contains(d.text, b.text) LEFT JOIN labels USING (doc_id) WHERE length(b.text) > 0""")
def v01(t):
    """Why a passage, read in a document, does not count, by the first reason that holds."""
    d = _cited(t)
    none = F.lit(None).cast("string")
    claims = {c: none for c, _ in D.CLAIMS if c[0] != "="} | {"duty_bearer": F.lower(F.substring("passage", 1, 20)), "duty_act": F.concat(F.substring("passage", 1, 12), F.lit(" ... "), F.right("passage", F.lit(12))), "place_words": F.when(F.col("toxic") == 1, F.concat(F.lit("the house of "), "source"))}
    own = {"allowed": F.col("lang") != "es", "heading": F.col("source"), "quote": F.col("passage"), "measure": F.when(F.char_length("passage") >= 12, F.col("lang")), "gloss": none, "name": none, "scope_stated": F.when(F.col("quality").isNotNull(), True), "sector_scope": F.lit("all"), "sector": none}
    readings = d.select("doc_id", "item_id", "text", *[c.alias(n) for n, c in {**own, **claims}.items()])
    return D.rejected(readings).select("doc_id", "item_id", "rejection")


@query("z04_export_gates", """
WITH c AS (SELECT doc_id * 1000 + item_id AS row_id, lang, quality, source, toxic FROM documents d JOIN benchmark b ON contains(d.text, b.text) LEFT JOIN labels USING (doc_id) WHERE length(b.text) > 0),
g AS (SELECT row_id, 'quote-in-source' AS gate, true AS passed FROM c UNION ALL SELECT row_id, 'offsets-resolve', quality IS DISTINCT FROM 0 FROM c UNION ALL SELECT row_id, 'pinpoint-citation', lang = 'en' FROM c UNION ALL SELECT row_id, 'in-force', quality IS NOT NULL AND toxic = 0 FROM c
  UNION ALL SELECT row_id, 'timeframe-evidenced', lang <> 'fr' FROM c UNION ALL SELECT row_id, 'one-measure', lang <> 'de' FROM c UNION ALL SELECT row_id, 'quote-leads', quality = 1 IS TRUE FROM c UNION ALL SELECT row_id, 'official-host', source <> 'src1' FROM c
  UNION ALL SELECT row_id, 'score-recorded', quality IS NOT NULL FROM c UNION ALL SELECT row_id, 'score-recomputes', toxic = 0 FROM c WHERE toxic IS NOT NULL)
SELECT row_id, string_agg(gate, ', ' ORDER BY gate) FILTER (NOT passed) AS failed, count(*) AS gates FROM g GROUP BY row_id""")
def z04_export(t):
    """The gates on export rows that cite the passages, in documents whose text stands behind a line of its own."""
    d = _cited(t)
    passage, toxic = F.col("passage"), F.col("toxic")
    at = F.char_length(F.expr("substring_index(text, passage, 1)")) + F.char_length("source") + 1 + F.when(F.col("quality") == 0, 1).otherwise(0)
    fields = {
        "section_id": F.col("doc_id"), "quote": passage, "section_text": F.col("text"), "doc_text": F.concat("source", F.lit("\n"), "text"), "start": at, "stop": at + F.char_length("passage"),
        "url": F.concat(F.lit("https://"), F.when(F.col("source") == "src1", "not").otherwise("laws."), F.lit("example.org/"), "source", F.when(F.col("lang") == "en", "#s1").otherwise("")), "hosts": F.array(F.lit("example.org")),
        "status": F.when(toxic == 0, "in-force").otherwise("repealed"), "status_basis": F.when(F.col("quality").isNotNull(), "register"), "last_amended": F.when(F.col("lang") == "fr", "2020"), "timeframe_basis": F.when(F.col("lang") == "fr", " "),
        "notes": F.when(F.col("lang") == "de", "Measure: a; Measure: b").otherwise("Measure: a"), "rationale": F.concat(F.when(F.col("quality") == 1, "“").otherwise("It says “"), passage, F.lit("”")), "state": F.lit("restricted"), "band": F.lit(1),
        "score": F.when(F.col("quality").isNotNull(), 0.5), "recomputed": toxic == 0, "framework_text": F.lit(None).cast("string"), "framework_verified": F.lit(None).cast("boolean"),
    }
    rows = d.select((F.col("doc_id") * 1000 + F.col("item_id")).alias("row_id"), *[c.alias(n) for n, c in fields.items()])
    failed = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ", ")
    return D.verified(rows).groupBy("row_id").agg(F.nullif(failed, F.lit("")).alias("failed"), F.count(F.lit(1)).alias("gates"))


@query("b08_framework_decision", """
WITH f AS (SELECT lang AS cell, source AS title, bool_or(quality = 1) AS e, count(*) FILTER (toxic = 1) = 0 AS shown, count(*) >= 12 AS wide FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source),
r AS (SELECT cell, title, CASE WHEN coalesce(e, false) AND shown AND wide THEN 1 WHEN coalesce(e, false) AND shown THEN 2 END AS r FROM f),
g AS (SELECT cell, min(r) AS best, string_agg(title, ', ' ORDER BY title) FILTER (r = 1) AS one, string_agg(title, ', ' ORDER BY title) FILTER (r = 2) AS two, count(*) AS n FROM r GROUP BY cell)
SELECT cell, CASE WHEN best IS NULL THEN 'no-restriction' ELSE 'restricted' END AS state, CASE best WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS ordinal,
  CASE best WHEN 1 THEN 'across sectors: ' || one WHEN 2 THEN 'limited in reach or subject: ' || two ELSE 'none of ' || n || ' examined' END AS reason FROM g""")
def b08_framework(t):
    """A cell for each language, its sources as the frameworks that are claimed."""
    d = t("documents").join(t("labels"), "doc_id", "left").groupBy("lang", "source").agg(F.max(F.col("quality") == 1).alias("establishes"), (F.count_if(F.col("toxic") == 1) == 0).alias("shown"), (F.count(F.lit(1)) >= 12).alias("across_sectors"))
    found = d.select(F.col("lang").alias("cell"), F.lit(1).alias("place"), F.col("source").alias("title"), "establishes", "shown", F.lit(False).alias("dedicated"), F.lit(None).cast("boolean").alias("dedicated_shown"), F.lit("binding").alias("binding"), "across_sectors")
    none = F.lit(None).cast("string")
    cells = d.groupBy(F.col("lang").alias("cell")).agg(F.count(F.lit(1)).cast("int").alias("examined")).select("cell", F.lit(3).alias("bands"), F.lit(False).alias("needs_dedicated"), none.alias("must"), none.alias("must_not"), F.lit(0).alias("unread"), "examined")
    return D.frameworks_decided(cells, found)


@query("v02_answers_coerced", """
SELECT conv_id * 1000 + turn AS id, turn % 5 = 4 OR turn % 5 = 3 AS unreadable,
  CASE WHEN turn % 5 < 3 THEN CASE turn % 5 WHEN 0 THEN 'assistant' ELSE role END END AS indicator, CASE WHEN turn % 5 < 3 THEN split_part(text, ' ', 1) END AS quote,
  CASE turn % 5 WHEN 0 THEN 'access' WHEN 1 THEN 'storage' END AS measure, CASE turn % 5 WHEN 2 THEN 'duty_force, mandatory' END AS missing FROM conversations""")
def v02_coerced(t):
    """Each turn as the answer of a reader; every fourth and fifth cannot be read."""
    spark = t("conversations").sparkSession
    dimension = spark.createDataFrame([("assistant", "access"), ("assistant", "storage"), ("user", "storage")], "indicator string, measure string")
    first, kind = F.split_part("text", F.lit(" "), F.lit(1)), F.col("turn") % 5
    facts = F.struct(F.col("role").alias("indicator"), F.concat(F.lit("  "), first, F.lit(" ")).alias("quote"), F.when(kind == 0, "access").when(kind == 1, " storage ").otherwise("cover").alias("measure"), F.when(kind == 2, "suggests").otherwise("requires").alias("duty_force"), F.when(kind != 2, True).alias("mandatory"), F.lit("organisation").alias("bearer"))
    nothing = F.to_json(F.struct(F.lit("user").alias("indicator"), F.lit(" n/a ").alias("quote")))
    answer = F.when(kind == 3, nothing).when(kind == 4, F.col("text")).otherwise(F.to_json(facts))
    return D.coerced(t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), answer.alias("answer")), dimension)
