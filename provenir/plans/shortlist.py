"""The register shortlist, definitions, drafting facts, extraction checks and reporting reads that remain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T


@query("k13_contents", "SELECT conv_id, string_agg(role || ':' || length(text), ' | ' ORDER BY turn) AS contents FROM conversations GROUP BY conv_id")
def k13(t):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.char_length("text").cast("string")).alias("x"))))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["x"]), " | ").alias("contents"))


@query("k12_follow_up", "SELECT doc_id // 10 AS parent, count(*) AS children, min(doc_id) AS first_child FROM documents WHERE doc_id // 10 IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1")
def k12(t):
    parents = t("labels").where("quality = 1").select(F.col("doc_id").alias("parent"))
    return t("documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("parent")).join(parents, "parent", "left_semi").groupBy("parent").agg(F.count("*").alias("children"), F.min("doc_id").alias("first_child"))


@query("j12_first_definition", "SELECT conv_id, split_part(text, ' ', 1) AS term, min(turn) AS defined_at FROM conversations GROUP BY ALL")
def j12(t):
    """The entry that defines a term is the first in section order."""
    return t("conversations").groupBy("conv_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("term")).agg(F.min("turn").alias("defined_at"))


@query("j22_carried_readings", "SELECT min(doc_id) AS doc_id, source, lang, n_chars % 5 AS measure FROM (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT * FROM documents) GROUP BY source, lang, n_chars % 5")
def j22(t):
    """Findings of an earlier run and of this one, each once."""
    d = t("documents").select("doc_id", "source", "lang", (F.col("n_chars") % 5).alias("measure"))
    return d.join(t("labels"), "doc_id", "left_semi").unionByName(d).groupBy("source", "lang", "measure").agg(F.min("doc_id").alias("doc_id"))


@query("j23_replayed_retrieval", "SELECT user_id, min(event_id) AS best, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS channels FROM events GROUP BY user_id")
def j23(t):
    return t("events").groupBy("user_id").agg(F.min("event_id").alias("best"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("channels"))


@query("a18_tally", "SELECT source, count(quality) AS asked, count(*) FILTER (quality = 0) AS denied FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a18(t):
    return t("documents").join(t("labels"), "doc_id", "left").groupBy("source").agg(F.count("quality").alias("asked"), F.count_if(F.col("quality") == 0).alias("denied"))


@query("a28_prefix_violations", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) FILTER (starts_with(split_part(url, split_part(split_part(url, '://', 2), '/', 1), 2), '/en/1')) AS violations FROM pages GROUP BY 1")
def a28(t):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    path = F.split_part(F.col("url"), host, F.lit(2))
    return t("pages").select(host.alias("host"), path.alias("path")).groupBy("host").agg(F.count_if(F.col("path").startswith("/en/1")).alias("violations"))


@query("a30_kind_counts", "SELECT p_brand, count(*) AS n, max(p_size) AS largest, round(avg(p_size), 4) AS mean_size FROM part GROUP BY p_brand")
def a30(t):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("largest"), F.round(F.avg("p_size"), 4).alias("mean_size"))


@query("p08_title_recogniser", "SELECT p_partkey, CASE WHEN length(p_name) BETWEEN 10 AND 170 AND NOT regexp_matches(p_name, '[.!?]$') THEN 'title' END AS kind FROM part")
def p08(t):
    named = F.char_length("p_name").between(10, 170) & ~F.col("p_name").rlike("[.!?]$")
    return t("part").select("p_partkey", F.when(named, "title").alias("kind"))


@query("p10_demoted_kinds", "SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' AND p_size < 10 THEN 'publication' WHEN p_type LIKE 'PROMO%' THEN 'act' ELSE 'notice' END AS kind FROM part")
def p10(t):
    act = F.col("p_type").startswith("PROMO")
    return t("part").select("p_partkey", F.when(act & (F.col("p_size") < 10), "publication").when(act, "act").otherwise("notice").alias("kind"))


@query("p18_states_an_amount", "SELECT doc_id, regexp_matches(text, '[0-9]+') AS states_amount, regexp_matches(lower(text), '(licen[cs]e|licensed)') AS licence_terms FROM documents")
def p18(t):
    return t("documents").select("doc_id", F.col("text").rlike("[0-9]+").alias("states_amount"), F.lower("text").rlike("(licen[cs]e|licensed)").alias("licence_terms"))


@query("p19_cited_tiers", "SELECT pattern, count(*) AS documents FROM documents, (SELECT unnest(['version', 'under', 'copyright']) AS pattern) WHERE contains(lower(text), pattern) GROUP BY pattern")
def p19(t):
    """Patterns of a profile (a fixed list) counted in one pass over the texts."""
    low = F.lower("text")
    hits = F.filter(F.array(*[F.when(low.contains(p), F.lit(p)) for p in ("version", "under", "copyright")]), lambda x: x.isNotNull())
    return t("documents").select(F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("documents"))


@query("p23_query_set", "SELECT q, min(n) AS first_at FROM (SELECT p_brand || ' ' || p_type AS q, p_partkey AS n FROM part UNION ALL SELECT p_name, p_partkey + 100000 FROM part) WHERE length(q) >= 12 GROUP BY q")
def p23(t):
    """Queries from two sources, each once, where it first stands."""
    p = t("part")
    both = p.select(F.concat_ws(" ", "p_brand", "p_type").alias("q"), F.col("p_partkey").alias("n")).unionByName(p.select(F.col("p_name").alias("q"), (F.col("p_partkey") + 100000).alias("n")))
    return both.where(F.char_length("q") >= 12).groupBy("q").agg(F.min("n").alias("first_at"))


@query("t15_same_words", "SELECT a.conv_id, a.turn, array_to_string(list_sort(list_distinct(string_split_regex(lower(a.text), '[^a-z]+'))), ' ') = array_to_string(list_sort(list_distinct(string_split_regex(lower(b.text), '[^a-z]+'))), ' ') AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2")
def t15(t):
    key = F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))), " ")
    c = t("conversations").select("conv_id", "turn", key.alias("k"))
    b = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("k").alias("o"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("k") == F.col("o")).alias("same"))


@query("t16_lists", "SELECT o_orderkey, upper(substr(o_orderpriority, 1, 1)) || lower(substr(o_orderpriority, 2)) AS shown FROM orders")
def t16(t):
    return t("orders").select("o_orderkey", F.concat(F.upper(F.substring("o_orderpriority", 1, 1)), F.lower(F.substring("o_orderpriority", 2, 100))).alias("shown"))


@query("m03_stated_proportion", "SELECT p_partkey, CASE WHEN p_size = 0 THEN 'none' WHEN p_size < 25 THEN 'some' END AS proportion FROM part")
def m03(t):
    return t("part").select("p_partkey", F.when(F.col("p_size") == 0, "none").when(F.col("p_size") < 25, "some").alias("proportion"))


@query("r02_coded_goods", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]{4}')) AS codes FROM documents")
def r02(t):
    return t("documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]{4}")).cast("long").alias("codes"))


@query("v02_coerced_answers", "SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IN ('0', '1') THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def v02(t):
    """Sentinels for nothing become null."""
    k = F.from_json("props", "k int")["k"]
    return t("events").select("event_id", F.when(~k.isin(0, 1), k).alias("k"))


@query("z02_row_language", "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 <> 0 THEN lang END, CASE WHEN doc_id % 8 <> 0 THEN 'xx' END, 'en') AS language FROM documents")
def z02(t):
    return t("documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 4 != 0, F.col("lang")), F.when(F.col("doc_id") % 8 != 0, F.lit("xx")), F.lit("en")).alias("language"))


@query("u03_rationale", "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_extract(substr(text, 1, 298), '(?s)^(.*)\\s', 1) || ' …' END AS rationale FROM documents")
def u03(t):
    return t("documents").select("doc_id", T.clipped(F.col("text"), 300).alias("rationale"))


@query("s27_last_amended", "SELECT c_custkey, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_amended FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def s27(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.max(F.to_date("o_orderdate")).cast("string").alias("last_amended"))


@query("n02_editions", "SELECT p_partkey, unnest(['a', 'b']) AS edition FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'a' FROM part WHERE p_size <= 40")
def n02(t):
    both = F.array(F.lit("a"), F.lit("b"))
    return t("part").select("p_partkey", F.explode(F.when(F.col("p_size") > 40, both).otherwise(F.array(F.lit("a")))).alias("edition"))


@query("n11_run_listing", "SELECT u.user_id, u.n, coalesce(p.n, 0) AS purchases FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) u LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) p USING (user_id)")
def n11(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


@query("y01_embedding_stub", None)
def y01(t):
    """A deterministic stand-in for the embedding model: hashed words, unit length."""
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(16)).cast("int")
    counts = t("documents").select("doc_id", F.explode(F.transform(T.tokens(F.col("text")), slot)).alias("d")).groupBy("doc_id", "d").agg(F.count("*").alias("n"))
    total = counts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(total, "doc_id").select("doc_id", "d", F.round(F.col("n") / F.col("norm"), 6).alias("v"))
