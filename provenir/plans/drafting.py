"""Drafting facts of provisions made from the documents' lines, and rationales of their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import drafting as D
from ..functions import titles as W


@query("t12_drafting_facts", """
WITH l AS (SELECT doc_id, lang, regexp_replace(split_part(text, chr(10), 1), '[^\\p{L} ]', '', 'g') AS x FROM documents)
SELECT doc_id, lang = 'en' AS amends, lang = 'fr' AND length(trim(left(x, 12))) >= 3 AS defines, lang = 'es' AND length(trim(left(x, 12))) >= 3 AS inherits, lang = 'de' AS replaceable, lang = 'en' AND length(trim(left(x, 12))) >= 3 AS inserts,
  CASE WHEN lang = 'en' THEN 'Data Act ' || (1900 + doc_id % 100) END AS amended, CASE WHEN lang = 'en' THEN 'Act ' || doc_id END AS number FROM l""")
def t12(t):
    """A provision about each document's first line, drafted in one of four ways by its language; which facts it states of the line's beginning."""
    line = F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"[^\p{L} ]", "")
    en = F.concat(F.lit("An Act to amend the Data Act "), (1900 + F.col("doc_id") % 100).cast("string"), F.lit(" [Act "), F.col("doc_id").cast("string"), F.lit("]. The principal Act is amended by inserting after section 3 the following: “"), F.col("x"), F.lit("”."))
    fr = F.concat(F.lit("In this Act—\n“carrier” means one who carries;\n“line” includes "), F.col("x"), F.lit(";\n\nThe rest is law."))
    es = F.concat(F.lit("A carrier must act. The Minister may by order require:\n(a) "), F.col("x"))
    de = F.concat(F.lit("A fee of "), F.format_number("doc_id", 0), F.lit(" or such other amount as is prescribed is due for "), F.col("x"))
    d = t("documents").select("doc_id", "lang", line.alias("x"))
    d = d.select("doc_id", F.when(F.col("lang") == "en", en).when(F.col("lang") == "fr", fr).when(F.col("lang") == "es", es).otherwise(de).alias("text"), F.left("x", F.lit(12)).alias("words"), F.format_number("doc_id", 0).alias("figure"))
    text, words = F.col("text"), F.col("words")
    what = D.amends_what(text)
    return d.select("doc_id", D.amends_another(text).alias("amends"), D.cites_definition(text, words).alias("defines"), D.inherits_power(text, words).alias("inherits"), D.figure_replaceable(text, F.col("figure")).alias("replaceable"), D.inserts_words(text, words).alias("inserts"), what["name"].alias("amended"), what["number"].alias("number"))


@query("b09_rationales", """
WITH s AS (SELECT source, count(*) AS n, count(quality) AS judged, count(*) FILTER (toxic = 1) AS bad, min(doc_id) FILTER (quality = 1 AND lang = 'en') AS lead FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT s.source, CASE WHEN lead IS NOT NULL THEN '"' || split_part(text, chr(10), 1) || '" (' || s.source || ', no. ' || lead || '). Scored 1 -- "Good English": one good document.'
  ELSE CASE WHEN judged > 0 THEN s.source || ' regulates this area -- ' || judged || ' requirement(s) of this pillar were read in it -- and imposes no good english.' ELSE 'No instrument in the corpus was found to regulate this area. The most relevant one the search returned, ' || s.source || ', imposes no good english.' END
    || ' Scored 0 -- "No good English". None found across ' || judged || ' provision(s) read for this indicator, out of ' || n || ' in the corpus.' END
  || CASE WHEN bad > 0 THEN ' ' || bad || ' measure(s) were found and not scored: Excludes what is toxic.' ELSE '' END AS rationale FROM s LEFT JOIN documents ON doc_id = lead""")
def b09(t):
    """Why each source has its score: its first good English document, or what was read of it."""
    d = t("documents").join(t("labels"), "doc_id", "left")
    good = F.when((F.col("quality") == 1) & (F.col("lang") == "en"), F.struct("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("line")))
    s = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("judged"), F.count_if(F.col("toxic") == 1).alias("bad"), F.min(good).alias("lead"))
    found = F.col("lead").isNotNull()
    basis = F.when(found, F.array(F.struct(F.col("lead.line").alias("quote"), F.col("source").alias("cited"), F.concat(F.lit("no. "), F.col("lead.doc_id").cast("string")).alias("heading"))))
    absence = F.struct((F.col("judged") > 0).alias("governing"), F.col("source").alias("instrument"), F.col("judged").alias("findings"), F.lit(None).cast("string").alias("current_to"))
    text = D.rationale(F.when(found, 1).otherwise(0), F.when(found, "Good English").otherwise("No good English"), F.when(found, "one good document").otherwise("none found"), basis, F.lit("Good English"), absence, F.col("judged"), F.col("n"), F.col("bad"), F.lit("Excludes what is toxic."))
    return s.select("source", text.alias("rationale"))


@query("p08_instrument_titles", """
WITH l AS (SELECT doc_id, lang, trim(left(regexp_replace(split_part(text, chr(10), 1), '[^\\p{L} ]', '', 'g'), 24)) AS x, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, lang = 'de' AS about, CASE lang WHEN 'en' THEN 'act' WHEN 'fr' THEN 'regulation' WHEN 'es' THEN 'guideline' END AS kind,
  CASE WHEN lang = 'en' AND toxic IS NULL THEN 'publication' WHEN lang = 'en' THEN 'act' WHEN lang = 'fr' THEN 'regulation' WHEN lang = 'es' THEN 'guideline' END AS registered FROM l""")
def p08_titles(t):
    """Titles made of the documents' first words, one form a language: their kinds, and what an Act counts as that states nothing of itself."""
    x = F.trim(F.left(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"[^\p{L} ]", ""), F.lit(24)))
    form = F.when(F.col("lang") == "en", F.concat(F.lit("The  "), x, F.lit(" Data Act (No. 7) 2019 reprint"))).when(F.col("lang") == "fr", F.concat(x, F.lit(" Data Regulations 2001"))).when(F.col("lang") == "es", F.concat(F.lit("Revised Guidelines for "), x)).otherwise(F.concat(F.lit("Understanding "), x, F.lit(" Data Act")))
    d = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", form.alias("title"), F.when(F.col("toxic").isNotNull(), F.concat(F.lit("No. "), F.col("doc_id").cast("string"))).alias("number"))
    kind = W.title_kind(F.col("title"))
    none = F.lit(None).cast("string")
    return d.select("doc_id", W.published_about(F.col("title")).alias("about"), kind.alias("kind"), W.registered_kind(kind, F.col("number"), F.lit("unknown"), none).alias("registered"))
