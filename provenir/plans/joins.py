"""Joins, set operations, predicates and writes of the corpus model, over the tables that stand in for it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import ledger as L
from ..operators import ordering as O
from ..operators import phrases as H
from ..operators import versions as V


@query("j01_inner_chain", "SELECT l_orderkey, l_linenumber, o_orderdate, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 45")
def j01(t):
    lines = t("lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    return lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "o_orderdate", "c_name", "n_name")


@query("j02_left_chain", "SELECT d.doc_id, d.source, quality, toxic, label FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings ON vec_id = d.doc_id")
def j02(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left").join(vectors, "doc_id", "left")


@query("j03_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j03(t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j04_pending_work", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def j04(t):
    """Incremental work: documents that the index does not hold yet."""
    return t("documents").join(t("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id", "source")


@query("j05_scalar_subqueries", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT CAST(max(o_totalprice) AS DOUBLE) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer")
def j05(t):
    own = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").cast("double").alias("largest"))
    return t("customer").select("c_custkey").join(own, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "largest")


@query("j06_self_join", "SELECT a.doc_id, b.doc_id AS parent_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 10 WHERE a.doc_id > 0")
def j06(t):
    """A rule and the act it was made under (here: the tenth of its id)."""
    child, parent = t("documents").select("doc_id"), t("documents").select(F.col("doc_id").alias("parent_id"))
    return child.where("doc_id > 0").join(parent, F.floor(F.col("doc_id") / 10) == F.col("parent_id"))


@query("j07_json_lateral", "SELECT DISTINCT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def j07(t):
    return t("events").select("event_type", F.from_json("props", "k int").alias("p")).select("event_type", "p.k").distinct()


@query("j08_titles_in_text", """
WITH t AS (SELECT DISTINCT lower(split_part(text, chr(10), 1)) AS title FROM documents WHERE length(split_part(text, chr(10), 1)) >= 12), d AS (SELECT doc_id, lower(text) AS x FROM documents)
SELECT title, count(*) AS documents FROM t JOIN d ON contains(x, title) GROUP BY title""")
def j08(t):
    """First lines of twelve characters or more as titles, and how many texts hold each: a pass over the texts for each two million titles."""
    line = F.substring_index("text", "\n", 1)
    titles = t("documents").where(F.char_length(line) >= 12).select(F.lower(line).alias("title")).distinct()
    return H.texts_that_hold(t("documents").select(F.lower("text").alias("text")), titles, phrase="title", n="documents")


@query("j09_known_or_new", """
WITH m AS (SELECT doc_id, 1 AS rule FROM documents d JOIN benchmark b ON d.text = b.text
  UNION ALL SELECT doc_id, 2 FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) >= 12
  UNION ALL SELECT doc_id, 3 FROM documents d JOIN benchmark b ON contains(b.text, d.text) WHERE length(d.text) >= 12),
k AS (SELECT doc_id, min(rule) AS rule FROM m GROUP BY doc_id)
SELECT doc_id, CASE WHEN rule IS NULL THEN 'NEW' ELSE 'KNOWN' END AS tag, rule FROM documents LEFT JOIN k USING (doc_id)""")
def j09(t):
    """Tag against a baseline: the same text first, then a text that holds a baseline's, then one that a baseline's holds."""
    return H.known_or_new(t("documents"), t("benchmark"))


@query("j10_parent_by_name", "SELECT a.s_suppkey, min(b.s_suppkey) AS parent FROM supplier a JOIN supplier b ON lower(trim(substr(a.s_name, 1, 14))) = lower(trim(substr(b.s_name, 1, 14))) AND a.s_suppkey <> b.s_suppkey GROUP BY a.s_suppkey")
def j10(t):
    name = F.lower(F.trim(F.substring("s_name", 1, 14)))
    a = t("supplier").select("s_suppkey", name.alias("n"))
    # of each name the two smallest keys are enough to find the smallest other one
    two = a.groupBy("n").agg(F.min("s_suppkey").alias("x"))
    second = a.join(two, "n").where("s_suppkey <> x").groupBy("n").agg(F.min("s_suppkey").alias("y"))
    return a.join(two, "n").join(second, "n").select("s_suppkey", F.when(F.col("s_suppkey") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("parent"))


@query("j15_identical_registrations", "SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY (n_chars IS NULL), doc_id) > 1 AS suppressed FROM documents")
def j15(t):
    """Of registrations with the same bytes the first stays."""
    return L.suppress_identical(t("documents"), "text", "doc_id").select("doc_id", "suppressed")


@query("j16_verbatim_copies", """
WITH g AS (SELECT text, count(DISTINCT source) AS owners, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS stands FROM documents LEFT JOIN labels USING (doc_id) GROUP BY text)
SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) JOIN g USING (text) WHERE owners > 1 AND stands = 1 AND coalesce(quality, 0) <> 1""")
def j16(t):
    """A bare copy goes if a copy of another owner stands."""
    marked = t("documents").select("doc_id", "source", "text").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return L.bare_copies(marked, "text", "source", F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id")


@query("j17_version_pairs", r"""
WITH c AS (SELECT conv_id, turn, turn % 2 AS side, left(text, 1) AS indicator, role AS url, lower(trim(regexp_replace(split_part(text, ' ', 1), '\s+', ' ', 'g'))) AS quote FROM conversations),
n1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(indicator), quote, side ORDER BY turn) AS r FROM c),
p1 AS (SELECT a.conv_id, a.turn AS first_id, b.turn AS second_id FROM n1 a JOIN n1 b ON a.conv_id = b.conv_id AND lower(a.indicator) = lower(b.indicator) AND a.quote = b.quote AND a.r = b.r AND a.side = 0 AND b.side = 1),
n2 AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id, lower(indicator), side ORDER BY turn) AS r FROM c WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.conv_id = c.conv_id AND c.turn IN (first_id, second_id))),
p2 AS (SELECT a.conv_id, a.turn AS first_id, b.turn AS second_id FROM n2 a JOIN n2 b ON a.conv_id = b.conv_id AND lower(a.indicator) = lower(b.indicator) AND a.r = b.r AND a.side = 0 AND b.side = 1),
n3 AS (SELECT n2.* EXCLUDE r, row_number() OVER (PARTITION BY n2.conv_id, side ORDER BY turn) AS r FROM n2 WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.conv_id = n2.conv_id AND n2.turn IN (first_id, second_id))),
p3 AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, a.turn AS first_id, b.turn AS second_id FROM (SELECT * FROM n3 WHERE side = 0) a FULL JOIN (SELECT * FROM n3 WHERE side = 1) b ON a.conv_id = b.conv_id AND a.r = b.r),
p AS (SELECT *, 1 AS pass FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, CASE WHEN first_id IS NULL OR second_id IS NULL THEN 0 ELSE 3 END FROM p3)
SELECT p.conv_id, first_id, second_id, pass, CASE WHEN second_id IS NULL THEN 'A' WHEN first_id IS NULL THEN 'B' ELSE 'both' END AS found_by,
  coalesce(lower(a.indicator) <> lower(b.indicator), false) AS indicator_differs, coalesce(a.url <> b.url, false) AS citation_differs, coalesce(a.quote <> b.quote, false) AS quote_differs
FROM p LEFT JOIN c a ON a.conv_id = p.conv_id AND a.turn = first_id LEFT JOIN c b ON b.conv_id = p.conv_id AND b.turn = second_id""")
def j17(t):
    """The even turns of a conversation against its odd ones, paired by first letter and first word, by first letter, by order."""
    c = t("conversations").select("conv_id", "turn", F.left("text", F.lit(1)).alias("indicator"), F.split_part("text", F.lit(" "), F.lit(1)).alias("quote"), F.col("role").alias("url"))
    return V.compared(c.where("turn % 2 = 0"), c.where("turn % 2 = 1"), ["conv_id"], "turn").drop("how_they_differ")


@query("j18_nearest_partner", """
WITH c AS (SELECT a.doc_id, b.doc_id AS partner, row_number() OVER (PARTITION BY a.doc_id ORDER BY (a.lang = b.lang) , abs(a.n_chars - b.n_chars), b.doc_id) AS rn FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id <> b.doc_id)
SELECT doc_id, partner FROM c WHERE rn = 1""")
def j18(t):
    """The run to compare with: another mode if there is one, then the nearest in size."""
    return O.nearest_partners(t("documents"), "source", "lang", "n_chars")


@query("j19_coverage_grid", """
WITH g AS (SELECT n_nationkey, seg FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer)), c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY ALL)
SELECT n_nationkey, seg, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'not-attempted' ELSE 'answered' END AS state FROM g LEFT JOIN c ON c_nationkey = n_nationkey AND c_mktsegment = seg""")
def j19(t):
    """Every cell of the grid of two small dimensions, answered or not."""
    segments = F.array(*[F.lit(r[0]) for r in t("customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()])  # a handful of names
    grid = t("nation").select("n_nationkey", F.explode(segments).alias("seg"))
    done = t("customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(done, ["n_nationkey", "seg"], "left").select("n_nationkey", "seg", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "not-attempted").otherwise("answered").alias("state"))


@query("j20_dimension_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j20(t):
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("j21_verdict_lookup", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not asked' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)")
def j21(t):
    """Three states: yes, no, not asked; a missing row is not a no."""
    asked = t("labels").select("doc_id", "quality")
    return t("documents").select("doc_id").join(asked, "doc_id", "left").select("doc_id", F.when(F.col("quality").isNull(), "not asked").when(F.col("quality") == 1, "yes").otherwise("no").alias("verdict"))


@query("j24_reanchored", """
WITH o AS (SELECT conv_id, turn, role, text FROM conversations WHERE turn % 2 = 0), n AS (SELECT conv_id, turn + 1 AS turn, text FROM conversations)
SELECT o.conv_id, o.turn, CASE WHEN s.m IS NOT NULL THEN 'text' WHEN p.conv_id IS NOT NULL THEN 'place' ELSE 'retired' END AS anchor FROM o LEFT JOIN (SELECT conv_id, text, min(turn) AS m FROM n GROUP BY ALL) s ON s.conv_id = o.conv_id AND s.text = o.text LEFT JOIN (SELECT DISTINCT conv_id, turn FROM n) p ON p.conv_id = o.conv_id AND p.turn = o.turn""")
def j24(t):
    """Citations after a re-parse: by the same text, else by the same place, else retired."""
    c = t("conversations")
    old = c.where("turn % 2 = 0").select("conv_id", "turn", "text")
    new = c.select("conv_id", (F.col("turn") + 1).alias("turn"), "text")
    return L.reanchored(old, new, "conv_id", "text", "turn").select("conv_id", "turn", "anchor")


@query("j25_offset_containment", """
WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(text) AS n FROM conversations), q AS (SELECT conv_id, max(a + n) // 2 AS mid FROM s GROUP BY conv_id)
SELECT s.conv_id, s.turn, CAST(mid AS BIGINT) AS mid FROM s JOIN q ON q.conv_id = s.conv_id AND mid >= a AND mid < a + n""")
def j25(t):
    """The section that holds a place of its document: a range join within the document."""
    s = L.with_offsets(t("conversations"), "conv_id", "turn", "text")
    middle = s.groupBy("conv_id").agg(F.floor(F.max("char_end") / 2).alias("mid"))
    return s.join(middle, "conv_id").where("mid >= char_start and mid < char_end").select("conv_id", "turn", "mid")


@query("x02_union_distinct", "SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def x02(t):
    return t("labels").where("quality = 0").select("doc_id").union(t("labels").where("toxic = 1").select("doc_id")).distinct()


@query("x03_except_suppressed", "SELECT doc_id FROM documents EXCEPT (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars < 200)")
def x03(t):
    """What is left when every suppression set is taken away."""
    gone = t("labels").where("toxic = 1").select("doc_id").union(t("documents").where("n_chars < 200").select("doc_id"))
    return t("documents").select("doc_id").join(gone, "doc_id", "left_anti").distinct()


@query("x04_intersect", "SELECT source FROM documents WHERE lang = 'de' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def x04(t):
    return t("documents").where("lang = 'de'").select("source").intersect(t("documents").where("lang = 'fr'").select("source"))


@query("x05_append_without_repeats", """
WITH u AS (SELECT doc_id, 1 AS src, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 30 UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM documents WHERE lang = 'en' QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 30)
SELECT doc_id, row_number() OVER (ORDER BY min(src * 1000 + r)) AS pos FROM u GROUP BY doc_id""")
def x05(t):
    first, second = (L.top(d, "n_chars", "doc_id", 30) for d in (t("documents"), t("documents").where("lang = 'en'")))
    return L.appended([first, second], "doc_id")


@query("s29_idempotent_store", "WITH u AS (SELECT doc_id, md5(text) AS h, 1 AS v FROM documents UNION ALL SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END), 2 FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, max(v) FILTER (v = 1 OR h <> old) AS version FROM (SELECT *, first_value(h) OVER (PARTITION BY doc_id ORDER BY v) AS old FROM u) GROUP BY doc_id")
def s29(t):
    """A re-read document replaces the stored one only if it changed."""
    stored = t("documents").select("doc_id", F.md5("text").alias("digest"), F.lit(1).alias("version"))
    again = t("documents").where("doc_id % 3 = 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("digest"), F.lit(2).alias("version"))
    return L.superseded(stored, again, ["doc_id"], "digest").select("doc_id", "version")


@query("s11_register_upsert", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.lang, a.lang) AS lang, coalesce(b.source, a.source) AS source FROM documents a FULL JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'xx' END AS lang, CASE WHEN toxic = 1 THEN 'new' END AS source FROM labels) b ON a.doc_id = b.doc_id")
def s11(t):
    """Known values stay where the new row has none."""
    d = t("documents").select("doc_id", "lang", "source")
    new = t("labels").select("doc_id", F.when(F.col("quality") == 1, "xx").alias("lang"), F.when(F.col("toxic") == 1, "new").alias("source"))
    return L.upserted(d, new, ["doc_id"])


@query("s37_purge", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src3', 'src4')")
def s37(t):
    return t("documents").join(t("documents").where(F.col("source").isin("src3", "src4")).select("source").distinct(), "source", "left_anti").select("doc_id", "source")


@query("s04_content_key", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def s04(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))


@query("p01_scope", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'FRANCE')")
def p01(t):
    scope = t("customer").join(F.broadcast(t("nation").where("n_name = 'FRANCE'").select(F.col("n_nationkey").alias("c_nationkey"))), "c_nationkey", "left_semi")
    return t("orders").join(scope.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("p02_register_search", "SELECT source, lang, count(*) AS n FROM documents WHERE lang = 'en' AND (text ILIKE '%tion%' OR source ILIKE '%tion%') GROUP BY ALL HAVING count(*) > 5 ORDER BY n DESC, source LIMIT 5 OFFSET 3")
def p02(t):
    found = t("documents").where("lang = 'en' and (text ilike '%tion%' or source ilike '%tion%')").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).where("n > 5")
    return found.orderBy(F.desc("n"), "source").offset(3).limit(5)


@query("p03_facets", "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL")
def p03(t):
    return t("documents").where("lang is not null").select("lang").distinct()


@query("p04_keyset_tail", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def p04(t):
    return L.tail(t("events"), "event_id", 500, 100).select("event_id", "event_type")
