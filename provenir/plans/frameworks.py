"""Framework candidates over the documents: a cell is a language, an owner a source in it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import frameworks as W


@query("k11_framework_candidates", """
WITH RECURSIVE d AS (SELECT doc_id, lang, source, length(text) AS n, (length(text) - length(replace(text, 'tion', ''))) // 4 AS f, md5(text) AS h FROM documents),
lv AS (SELECT source FROM d LEFT JOIN labels USING (doc_id) GROUP BY source HAVING count(*) FILTER (toxic = 1) <= count(*) FILTER (quality = 1)),
re AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rank FROM d GROUP BY lang, source QUALIFY rank <= 32),
sx AS (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY f DESC, doc_id) AS rank FROM d WHERE f > 0 QUALIFY rank <= 12),
rt AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY max(n) DESC, source) AS rank FROM d GROUP BY lang, source QUALIFY rank <= 8),
al AS (SELECT lang, source, 0 AS l, row_number() OVER (PARTITION BY lang ORDER BY rank) AS nth FROM re SEMI JOIN lv USING (source)
  UNION ALL SELECT lang, source, 1, row_number() OVER (PARTITION BY lang ORDER BY rank) FROM (SELECT lang, source, min(rank) AS rank FROM sx GROUP BY lang, source) SEMI JOIN lv USING (source)
  UNION ALL SELECT lang, source, 2, row_number() OVER (PARTITION BY lang ORDER BY rank) FROM rt SEMI JOIN lv USING (source)),
ls AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY min(nth * 10 + l)) AS place FROM al GROUP BY lang, source),
pa AS (SELECT d.source, min(o.source) AS parent FROM d JOIN d o ON d.h = o.h AND o.source <> d.source AND o.doc_id < d.doc_id SEMI JOIN lv ON lv.source = o.source GROUP BY d.source),
wk AS (SELECT lang, 0::BIGINT AS place, []::VARCHAR[] AS done FROM ls GROUP BY lang
  UNION ALL SELECT wk.lang, ls.place, CASE WHEN list_contains(done, ls.source) THEN done WHEN parent IS NULL OR list_contains(done, parent) THEN list_append(done, ls.source) ELSE list_append(list_append(done, parent), ls.source) END
  FROM wk JOIN ls ON ls.lang = wk.lang AND ls.place = wk.place + 1 LEFT JOIN pa ON pa.source = ls.source),
en AS (SELECT lang, arg_max(done, place) AS done FROM wk GROUP BY lang),
ou AS (SELECT lang, unnest(done) AS source, generate_subscripts(done, 1) AS rank FROM en),
sc AS (SELECT lang, source, list(doc_id ORDER BY rank) AS s FROM sx GROUP BY lang, source)
SELECT ou.lang, ou.source, ou.rank, array_to_string(CASE WHEN ls.place IS NULL THEN s[1:4] ELSE s END, ',') AS sections FROM ou LEFT JOIN ls USING (lang, source) LEFT JOIN sc USING (lang, source)""")
def k11(t):
    """Sources by how many documents they hold, by the documents richest in a term, by their longest one; the source that a text was first in stands before those that repeat it."""
    body = F.col("text")
    d = t("documents").select("doc_id", "lang", "source", F.char_length(body).alias("n"), F.floor((F.char_length(body) - F.char_length(F.replace(body, F.lit("tion"), F.lit("")))) / 4).alias("f"), F.md5(body).alias("h"))
    marked = d.join(t("labels"), "doc_id", "left").groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"))
    live = marked.where("bad <= good").select("source")
    ranked = lambda rows, *order: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    register = ranked(d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("k")), F.desc("k"), "source").where("rank <= 32")
    sections = ranked(d.where("f > 0"), F.desc("f"), "doc_id").where("rank <= 12").select("lang", "source", "doc_id", "rank")
    retrieved = ranked(d.groupBy("lang", "source").agg(F.max("n").alias("k")), F.desc("k"), "source").where("rank <= 8")
    # the first document of each text, and the sources that repeat it later
    first = d.join(live, "source", "left_semi").groupBy("h", "source").agg(F.min("doc_id").alias("at")).select("h", F.col("source").alias("parent"), "at")
    parents = d.join(first, "h").where("source != parent and at < doc_id").groupBy("source").agg(F.min("parent").alias("parent"))
    out = W.candidates(register, sections, retrieved, parents, live, ["lang"], "source", "doc_id")
    return out.select("lang", "source", "rank", F.array_join(F.transform("sections", lambda x: x.cast("string")), ",").alias("sections"))
