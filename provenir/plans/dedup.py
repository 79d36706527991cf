"""Model calls around deterministic stand-ins, memo tables, translations pairs, prescribed amounts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T


@query("y04_memo", "SELECT doc_id, lang || ':' || length(text) AS answer, doc_id % 3 = 0 AS cached FROM documents")
def y04(t):
    """Answers from the memo where the request is known, else from the (deterministic) engine."""
    key = F.sha2(F.concat_ws("|", "lang", F.char_length("text").cast("string")), 256)
    answer = F.concat("lang", F.lit(":"), F.char_length("text").cast("string"))
    asked = t("documents").select("doc_id", key.alias("key"), answer.alias("engine"))
    memo = asked.where("doc_id % 3 = 0").select("doc_id", F.col("engine").alias("known"))
    return asked.join(memo, "doc_id", "left").select("doc_id", F.coalesce("known", "engine").alias("answer"), F.col("known").isNotNull().alias("cached"))


@query("y07_questions_once", "SELECT count(*) AS questions FROM (SELECT DISTINCT source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def y07(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("source", "lang").distinct().agg(F.count("*").alias("questions"))


@query("j11_dictionary_citations", """
WITH w AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ') AS w FROM documents),
t AS (SELECT name FROM (SELECT lower(p_name) AS name FROM part UNION ALL SELECT 'of the' UNION ALL SELECT 'and the') GROUP BY name HAVING count(*) = 1),
k AS (SELECT DISTINCT len(string_split(name, ' ')) AS k FROM t WHERE len(string_split(name, ' ')) <= 31),
g AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, k WHERE len(w) >= k)
SELECT doc_id, count(*) AS citations FROM (SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS name FROM g) JOIN t USING (name) GROUP BY doc_id""")
def j11(t):
    """Spans of up to 31 words looked up among whole titles, in one pass over whole texts; a title that occurs twice names nothing."""
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")
    fixed = t("part").limit(1).select(F.explode(F.array(F.lit("of the"), F.lit("and the"))).alias("name"))
    titles = t("part").select(F.lower("p_name").alias("name")).unionByName(fixed).groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name")
    sized = titles.withColumn("k", F.size(F.split("name", " "))).where("k <= 31")
    lengths = sorted(r["k"] for r in sized.select("k").distinct().collect())  # 31 numbers at most

    def spans(k: int) -> F.Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, k), " "))
        return F.when(F.size("w") >= k, each).otherwise(F.array().cast("array<string>"))

    every = F.flatten(F.array(*map(spans, lengths)))
    return t("documents").select("doc_id", words.alias("w")).select("doc_id", F.explode(every).alias("name")).join(sized, "name").groupBy("doc_id").agg(F.count("*").alias("citations"))


@query("j13_pointer_overlap", """
WITH w AS (SELECT conv_id, turn, role, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}]+'), lambda w: length(w) >= 3)) AS w FROM conversations),
c AS (SELECT a.conv_id, a.turn, b.turn AS target, len(list_intersect(a.w, b.w)) AS shared, round(len(list_intersect(a.w, b.w)) / sqrt(greatest(len(b.w), 1)), 6) AS score FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role <> 'user')
SELECT conv_id, turn, target, score FROM c WHERE shared >= 3 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, target) <= 2""")
def j13(t):
    """For each pointer the two sections of its document that share most words with it."""
    w = t("conversations").select("conv_id", "turn", "role", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    a = w.where("role = 'user'").select("conv_id", "turn", "w")
    b = w.where("role <> 'user'").select("conv_id", F.col("turn").alias("target"), F.col("w").alias("v"))
    c = a.join(b, "conv_id").withColumn("shared", F.size(F.array_intersect("w", "v"))).where("shared >= 3").withColumn("score", F.round(F.col("shared") / F.sqrt(F.greatest(F.size("v"), F.lit(1))), 6))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "target"))
    return c.withColumn("n", nth).where("n <= 2").select("conv_id", "turn", "target", "score")


@query("n12_zero_fetch_proof", "SELECT count(*) AS cited, count(*) FILTER (vec_id IS NULL) AS not_fetched FROM labels LEFT JOIN embeddings ON vec_id = doc_id")
def n12(t):
    fetched = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("f"))
    return t("labels").join(fetched, "doc_id", "left").agg(F.count("*").alias("cited"), F.count_if(F.col("f").isNull()).alias("not_fetched"))


@query("n17_repairs", "SELECT doc_id, upper(lang) AS lang FROM documents WHERE upper(lang) IS DISTINCT FROM lang")
def n17(t):
    """A repair job shows the rows that it would change."""
    new = F.upper("lang")
    return t("documents").withColumn("new", new).where(~F.col("new").eqNullSafe(F.col("lang"))).select("doc_id", F.col("new").alias("lang"))


@query("n19_changed_fields", "SELECT a.doc_id, concat_ws(',', CASE WHEN a.quality IS DISTINCT FROM b.quality THEN 'quality' END, CASE WHEN a.toxic IS DISTINCT FROM b.toxic THEN 'toxic' END) AS changed FROM labels a JOIN (SELECT doc_id, 1 AS quality, toxic FROM labels) b USING (doc_id) WHERE a.quality IS DISTINCT FROM b.quality")
def n19(t):
    """Which fields a reviewer's edit has changed."""
    before = F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))
    after = F.create_map(F.lit("quality"), F.lit(1), F.lit("toxic"), F.col("toxic"))
    changed = F.map_filter(F.map_zip_with(before, after, lambda k, x, y: ~x.eqNullSafe(y)), lambda k, v: v)
    return t("labels").select("doc_id", F.array_join(F.map_keys(changed), ",").alias("changed")).where("changed <> ''")
