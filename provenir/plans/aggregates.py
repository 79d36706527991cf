"""Reports: counts, roll-ups, pivots, comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query


@query("a01_corpus_overview", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars, count(quality) AS labelled, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a01(t):
    return t("documents").join(t("labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("chars"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("a02_stratified_expectation", """
WITH s AS (SELECT source, lang, count(*) AS n, count(quality) AS have, count(*) FILTER (quality = 1) AS cited FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)
SELECT source, CAST(sum(cited) AS BIGINT) AS cited, round(sum(cited * have / n), 6) AS expected FROM s GROUP BY source""")
def a02(t):
    s = t("documents").join(t("labels"), "doc_id", "left").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count("quality").alias("have"), F.count_if(F.col("quality") == 1).alias("cited"))
    return s.groupBy("source").agg(F.sum("cited").alias("cited"), F.round(F.sum(F.col("cited") * F.col("have") / F.col("n")), 6).alias("expected"))


@query("a03_density_per_parser", "SELECT lang, round(avg(n_chars), 4) AS avg_chars, round(count(*) * 10000.0::DOUBLE / sum(n_chars), 6) AS density, round(count(*) * 10000.0::DOUBLE / sum(n_chars), 6) < max(round(count(*) * 10000.0::DOUBLE / sum(n_chars), 6)) OVER () / 4 AS fallback FROM documents GROUP BY lang")
def a03(t):
    d = t("documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 4).alias("avg_chars"), F.round(F.count("*") * 10000.0 / F.sum("n_chars"), 6).alias("density"))
    return d.withColumn("fallback", F.col("density") < F.max("density").over(Window.partitionBy()) / 4)  # a row a language


@query("a04_length_histogram", "SELECT count(*) FILTER (n_chars < 2000) AS short, count(*) FILTER (n_chars >= 2000 AND n_chars < 20000) AS middle, count(*) FILTER (n_chars >= 20000) AS long, max(n_chars) AS longest FROM (SELECT source, lang, max(n_chars) AS n_chars FROM documents GROUP BY source, lang, doc_id HAVING count(*) = 1)")
def a04(t):
    one = t("documents").groupBy("source", "lang", "doc_id").agg(F.count("*").alias("c"), F.max("n_chars").alias("n")).where("c = 1")
    return one.agg(F.count_if(F.col("n") < 2000).alias("short"), F.count_if((F.col("n") >= 2000) & (F.col("n") < 20000)).alias("middle"), F.count_if(F.col("n") >= 20000).alias("long"), F.max("n").alias("longest"))


@query("a05_duplicate_titles", "WITH d AS (SELECT split_part(text, chr(10), 1) AS title FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1) SELECT doc_id, source FROM documents WHERE split_part(text, chr(10), 1) IN (SELECT title FROM d)")
def a05(t):
    """Documents whose first line several sources have."""
    titled = t("documents").select("doc_id", "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    again = titled.groupBy("title").agg(F.count_distinct("source").alias("n")).where("n > 1")
    return titled.join(again, "title", "left_semi").select("doc_id", "source")


@query("a06_read_xor_unread", "SELECT count(*) AS n, count(*) FILTER (vec_id IS NOT NULL AND l.doc_id IS NOT NULL) AS in_both, count(*) FILTER (vec_id IS NULL AND l.doc_id IS NULL) AS in_neither FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings ON vec_id = d.doc_id")
def a06(t):
    a, b = t("labels").select("doc_id", F.lit(True).alias("a")), t("embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("b"))
    d = t("documents").select("doc_id").join(a, "doc_id", "left").join(b, "doc_id", "left")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("a") & F.col("b")).alias("in_both"), F.count_if(F.col("a").isNull() & F.col("b").isNull()).alias("in_neither"))


@query("a08_sibling_idf", """
WITH w AS (SELECT DISTINCT p_brand, p_partkey, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS term FROM part), n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)
SELECT p_brand, term, count(*) AS df, round(ln(any_value(n) / count(*)), 6) AS idf FROM w JOIN n USING (p_brand) WHERE length(term) >= 3 GROUP BY p_brand, term""")
def a08(t):
    p = t("part").select("p_brand", "p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), "[^a-z0-9]+"))).alias("term")).where(F.char_length("term") >= 3)
    n = t("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return p.groupBy("p_brand", "term").agg(F.count("*").alias("df")).join(n, "p_brand").select("p_brand", "term", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


@query("a13_citation_tally", """
WITH c AS (SELECT doc_id // 7 AS parent, count(*) AS children FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1), b AS (SELECT vec_id // 5 AS parent, count(*) AS cited FROM embeddings GROUP BY 1)
SELECT doc_id, 3 * coalesce(children, 0) + coalesce(cited, 0) AS score FROM documents LEFT JOIN c ON c.parent = doc_id LEFT JOIN b ON b.parent = doc_id WHERE 3 * coalesce(children, 0) + coalesce(cited, 0) >= 2 ORDER BY score DESC, doc_id LIMIT 50""")
def a13(t):
    c = t("documents").where("doc_id % 7 <> 0").groupBy(F.floor(F.col("doc_id") / 7).alias("doc_id")).agg(F.count("*").alias("children"))
    b = t("embeddings").groupBy(F.floor(F.col("vec_id") / 5).alias("doc_id")).agg(F.count("*").alias("cited"))
    score = 3 * F.coalesce("children", F.lit(0)) + F.coalesce("cited", F.lit(0))
    return t("documents").select("doc_id").join(c, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", score.alias("score")).where("score >= 2").orderBy(F.desc("score"), "doc_id").limit(50)


@query("a14_distinct_measures", "WITH m AS (SELECT l_orderkey, min(l_linestatus || '::' || l_returnflag) AS m FROM lineitem GROUP BY l_orderkey) SELECT o_orderpriority, count(DISTINCT m) AS measures FROM orders JOIN m ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def a14(t):
    least = t("lineitem").groupBy("l_orderkey").agg(F.min(F.concat("l_linestatus", F.lit("::"), "l_returnflag")).alias("m"))
    return t("orders").join(least, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count_distinct("m").alias("measures"))


@query("a15_distinct_sectors", "SELECT source, count(DISTINCT coalesce(lower(trim(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END)), '')) AS sectors FROM documents GROUP BY source")
def a15(t):
    return t("documents").groupBy("source").agg(F.count_distinct(F.coalesce(F.lower(F.trim(F.when(F.col("doc_id") % 3 != 0, F.col("lang")))), F.lit(""))).alias("sectors"))


@query("a16_least_firm_figure", """
WITH f AS (SELECT l_suppkey, l_extendedprice AS usd, l_orderkey * 10 + l_linenumber AS k, l_returnflag = 'A' AS firm FROM lineitem), a AS (SELECT l_suppkey, max(firm) AS any_firm FROM f GROUP BY l_suppkey)
SELECT l_suppkey, CAST(usd AS DOUBLE) AS usd, k FROM f JOIN a USING (l_suppkey) WHERE firm OR NOT any_firm QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY usd, k) = 1""")
def a16(t):
    """The least firm figure of each group; if none is firm, the least of all."""
    f = t("lineitem").select("l_suppkey", F.struct(F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("soft"), F.col("l_extendedprice").alias("usd"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).alias("x"))
    return f.groupBy("l_suppkey").agg(F.min("x").alias("x")).select("l_suppkey", F.col("x.usd").cast("double").alias("usd"), "x.k")


@query("a17_agreed_verdict", "SELECT source, CASE WHEN count(DISTINCT quality) = 1 THEN min(quality) END AS verdict, count(quality) AS asked FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, n_chars // 1000 % 2 = 0")
def a17(t):
    d = t("documents").join(t("labels"), "doc_id", "left").groupBy("source", F.floor(F.col("n_chars") / 1000) % 2 == 0).agg(F.when(F.count_distinct("quality") == 1, F.min("quality")).alias("verdict"), F.count("quality").alias("asked"))
    return d.select("source", "verdict", "asked")


@query("a19_gate_tallies", "WITH g AS (SELECT doc_id, unnest(['short', 'toxic', 'quality']) AS gate, unnest([n_chars >= 200, coalesce(toxic, 0) = 0, coalesce(quality, 1) = 1]) AS passed FROM documents LEFT JOIN labels USING (doc_id)) SELECT gate, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM g GROUP BY gate")
def a19(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    gates = {"short": F.col("n_chars") >= 200, "toxic": F.coalesce("toxic", F.lit(0)) == 0, "quality": F.coalesce("quality", F.lit(1)) == 1}
    long = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("passed")) for k, v in gates.items()])).alias("g")).select("doc_id", "g.*")
    return long.groupBy("gate").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


@query("a20_score_agreement", "SELECT count(*) AS n, count(*) FILTER (a.quality IS NOT DISTINCT FROM b.toxic) AS same FROM labels a FULL JOIN (SELECT doc_id + 1 AS doc_id, toxic FROM labels) b USING (doc_id)")
def a20(t):
    b = t("labels").select((F.col("doc_id") + 1).alias("doc_id"), F.col("toxic").alias("other"))
    return t("labels").join(b, "doc_id", "full").agg(F.count("*").alias("n"), F.count_if(F.col("quality").eqNullSafe(F.col("other"))).alias("same"))


@query("a21_lost_evidence", "SELECT split_part(source, 'c', 2) AS unit, count(*) AS lost FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def a21(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").groupBy(F.split_part("source", F.lit("c"), F.lit(2)).alias("unit")).agg(F.count("*").alias("lost"))


@query("a22_stage_totals", "SELECT event_type AS stage, count(*) AS items, round(sum(value), 4) AS seconds FROM events GROUP BY 1")
def a22(t):
    return t("events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("items"), F.round(F.sum("value"), 4).alias("seconds"))


@query("a23_costs_unknown_is_null", "SELECT user_id, CASE WHEN max(CASE WHEN value > 99 THEN 1 ELSE 0 END) = 1 THEN NULL ELSE round(sum(value), 4) END AS usd FROM events GROUP BY user_id")
def a23(t):
    """A sum with an unknown part is unknown, not zero."""
    return t("events").groupBy("user_id").agg(F.when(F.max((F.col("value") > 99).cast("int")) == 1, None).otherwise(F.round(F.sum("value"), 4)).alias("usd"))


@query("a24_complete_means", """
WITH c AS (SELECT source, lang, count(*) AS n, count(quality) AS have, avg(quality) AS score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL), p AS (SELECT source, lang, CASE WHEN have * 2 >= n THEN score END AS score FROM c)
SELECT source, round(avg(score), 6) AS score, count(score) AS complete FROM p GROUP BY source""")
def a24(t):
    """A mean of means; a part counts only if enough of it is answered."""
    c = t("documents").join(t("labels"), "doc_id", "left").groupBy("source", "lang").agg(F.when(F.count("quality") * 2 >= F.count("*"), F.avg("quality")).alias("score"))
    return c.groupBy("source").agg(F.round(F.avg("score"), 6).alias("score"), F.count("score").alias("complete"))


@query("a24_rollup_totals", "SELECT source, lang, count(*) AS n, CAST(grouping_id(source, lang) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (source, lang)")
def a24b(t):
    return t("documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("a25_coverage_matrix", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def a25(t):
    return t("documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count("doc_id")).na.fill(0)


@query("a26_moving_median_eta", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT user_id, round(median(value), 6) AS typical, count(*) AS seen FROM r WHERE rn <= 40 GROUP BY user_id""")
def a26(t):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return t("events").withColumn("rn", nth).where("rn <= 40").groupBy("user_id").agg(F.round(F.percentile("value", 0.5), 6).alias("typical"), F.count("*").alias("seen"))


@query("a27_reasons", "SELECT split_part(text, ' ', 1) AS reason, count(DISTINCT doc_id) AS subjects, count(DISTINCT CASE WHEN quality IS NULL THEN doc_id END) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a27(t):
    return t("documents").join(t("labels"), "doc_id", "left").groupBy(F.split_part("text", F.lit(" "), F.lit(1)).alias("reason")).agg(F.count_distinct("doc_id").alias("subjects"), F.count_distinct(F.when(F.col("quality").isNull(), F.col("doc_id"))).alias("missing"))


@query("a29_duplicate_labels", "SELECT conv_id, role, text, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1")
def a29(t):
    return t("conversations").groupBy("conv_id", "role", "text").agg(F.count("*").alias("n")).where("n > 1")


@query("a31_makespan", "SELECT event_type, round(greatest(sum(value) / 4, max(value)), 4) AS makespan FROM events GROUP BY event_type")
def a31(t):
    return t("events").groupBy("event_type").agg(F.round(F.greatest(F.sum("value") / 4, F.max("value")), 4).alias("makespan"))


@query("a32_engine_comparison", "SELECT count(*) FILTER (b.doc_id IS NULL) AS a_only, count(*) FILTER (a.doc_id IS NULL) AS b_only, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS in_both, count(*) FILTER (a.quality = b.quality) AS identical FROM labels a FULL JOIN (SELECT doc_id + 3 AS doc_id, quality FROM labels) b ON a.doc_id = b.doc_id")
def a32(t):
    a, b = t("labels").select("doc_id", F.col("quality").alias("qa")), t("labels").select((F.col("doc_id") + 3).alias("doc_id"), F.col("quality").alias("qb"))
    return a.join(b, "doc_id", "full").agg(F.count_if(F.col("qb").isNull()).alias("a_only"), F.count_if(F.col("qa").isNull()).alias("b_only"), F.count_if(F.col("qa").isNotNull() & F.col("qb").isNotNull()).alias("in_both"), F.count_if(F.col("qa") == F.col("qb")).alias("identical"))


@query("a33_checklist", "SELECT count(DISTINCT lang) AS langs, count(*) FILTER (lang <> 'en') AS foreign_rows, count(DISTINCT source) AS sources, count(*) FILTER (text LIKE '%\"%') AS quoted FROM documents")
def a33(t):
    return t("documents").agg(F.count_distinct("lang").alias("langs"), F.count_if(F.col("lang") != "en").alias("foreign_rows"), F.count_distinct("source").alias("sources"), F.count_if(F.col("text").contains('"')).alias("quoted"))


@query("a34_candidates_by_sections", "SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS pos FROM documents GROUP BY source")
def a34(t):
    n = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "source")))  # a row a source


@query("a35_top_headings", """
WITH h AS (SELECT source, split_part(text, ' ', 1) AS heading, min(doc_id) AS first_id FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_id, heading) AS rn FROM h)
SELECT source, string_agg(heading, ' > ' ORDER BY rn) AS contents FROM r WHERE rn <= 24 GROUP BY source""")
def a35(t):
    h = t("documents").groupBy("source", F.split_part("text", F.lit(" "), F.lit(1)).alias("heading")).agg(F.min("doc_id").alias("first_id"))
    r = h.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("first_id", "heading"))).where("rn <= 24")
    return r.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "heading"))), lambda x: x["heading"]), " > ").alias("contents"))


@query("n14_answer_stability", "SELECT a.role, count(*) AS n, count(*) FILTER (a.text IS NOT DISTINCT FROM b.text) AS same FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn GROUP BY a.role")
def n14(t):
    c = t("conversations")
    b = c.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("text").alias("other"))
    return c.join(b, ["conv_id", "turn"], "left").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("text").eqNullSafe(F.col("other"))).alias("same"))


@query("n15_reparse_diff", """
WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 4 <> 0), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 9 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT CASE WHEN b.h IS NULL THEN 'lost' WHEN a.h IS NULL THEN 'new' WHEN a.h = b.h THEN 'kept' ELSE 'changed' END AS outcome, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1""")
def n15(t):
    d = t("documents").select("doc_id", "text")
    a = d.where("doc_id % 4 <> 0").select("doc_id", F.md5("text").alias("ha"))
    b = d.where("doc_id % 5 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("hb"))
    outcome = F.when(F.col("hb").isNull(), "lost").when(F.col("ha").isNull(), "new").when(F.col("ha") == F.col("hb"), "kept").otherwise("changed")
    return a.join(b, "doc_id", "full").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("n10_rubric_book", "SELECT quality, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS answered FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def n10(t):
    return t("labels").join(t("documents").select("doc_id", "source"), "doc_id").groupBy("quality").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("answered"))


@query("z06_corpus_audit", "SELECT 'length stated wrong' AS finding, count(*) AS n FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'empty text', count(*) FROM documents WHERE text IS NULL OR text = '' UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def z06(t):
    """Invariants of the model as one report; every count should be zero."""
    d = t("documents")
    parts = [
        ("length stated wrong", d.where(F.col("n_chars") != F.char_length("text"))),
        ("empty text", d.where("text is null or text = ''")),
        ("label without document", t("labels").join(d, "doc_id", "left_anti")),
        ("line without order", t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")),
    ]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n")
        out = one if out is None else out.unionByName(one)
    return out
