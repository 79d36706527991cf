"""Retrieval queries: documents are the sections, ``source`` owns them, embeddings are their vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..catalog import query
from ..operators import indicator as I
from ..operators import retrieval as R

#: The terms of the demonstration search, one run each.
TERMS = ("tion", "licen", "heit")

_D = "greatest(length(text) - 2, 0)"


def _occ(t: str) -> str:
    return f"CAST((length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)} AS BIGINT)"


def _bm25_sql(terms: tuple[str, ...]) -> str:
    counts = ", ".join(f"{_occ(t)} AS f{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    idf = "CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join("(" + idf.format(i=i) + f") * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / avgd))" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"c AS (SELECT doc_id, source, {_D} AS d, {counts} FROM documents), st AS (SELECT count(*) AS n, avg(d) AS avgd, {stats} FROM c), b AS (SELECT doc_id, source, round({score}, 6) AS score FROM c, st WHERE {some})"


@query("k01_lexical_search", f"WITH {_bm25_sql(TERMS)} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 50")
def k01(t):
    return I.lexical_runs(t("documents"), [list(TERMS)], 50).drop("run_no")


@query("k02_phrase_search", "WITH " + _bm25_sql(("of the",)) + " SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 50")
def k02(t):
    return I.lexical_runs(t("documents"), [["of the"]], 50).drop("run_no")


@query("a09_bm25_statistics", "SELECT count(*) AS n, round(avg(" + _D + "), 6) AS avg_grams, " + ", ".join(f"count(*) FILTER (contains(lower(text), '{x}')) AS df_{x}" for x in TERMS) + " FROM documents")
def a09(t):
    low = F.lower("text")
    return t("documents").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(R.grams(F.col("text"))), 6).alias("avg_grams"), *[F.count_if(low.contains(x)).alias(f"df_{x}") for x in TERMS])


@query("s02_gram_postings", """
WITH c AS (SELECT doc_id, string_split(lower(text), '') AS c FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(c) - 2, 0) + 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM c)
SELECT gram, doc_id, count(*) AS tf FROM g WHERE length(gram) = 3 GROUP BY ALL""")
def s02(t):
    return R.postings(t("documents"))


def _query_vector(t):
    return [float(x) for x in t("embeddings").orderBy("vec_id").select("embedding").first()[0]]  # one row


_DENSE = "qv AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), dn AS (SELECT vec_id AS doc_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings, qv)"


@query("k04_dense_search", f"WITH {_DENSE} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM dn QUALIFY rank <= 50")
def k04(t):
    v = R.checked_vectors(t("embeddings"), 64)
    return R.ranked(v.select(F.col("vec_id").alias("doc_id"), R.inner(F.col("embedding"), _query_vector(t)).alias("score")), [], k=50)


@query("m05_unit_vectors", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings")
def m05(t):
    square = F.aggregate(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    return t("embeddings").select("vec_id", F.round(F.sqrt(square), 4).alias("norm"))


@query("p20_vector_integrity", "SELECT label, count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_length, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS not_finite FROM embeddings GROUP BY label")
def p20(t):
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return t("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != 64).alias("wrong_length"), F.count_if(odd).alias("not_finite"))


def _runs(t):
    """One lexical run a term and one dense run: (run_no, channel, doc_id, rank)."""
    docs = t("documents")
    out = I.lexical_runs(docs, [[term] for term in TERMS], R.PER_QUERY).select("run_no", F.lit("lexical").alias("channel"), "doc_id", "rank")
    dense = R.ranked(t("embeddings").select(F.col("vec_id").alias("doc_id"), R.inner(F.col("embedding"), _query_vector(t)).alias("score")), [], k=R.PER_QUERY)
    dense = dense.join(docs.select("doc_id"), "doc_id", "left_semi")
    return out.unionByName(dense.select(F.lit(len(TERMS)).alias("run_no"), F.lit("dense").alias("channel"), "doc_id", "rank"))


def _runs_sql() -> str:
    ctes, parts = [], []
    for i, term in enumerate(TERMS):
        inner = _bm25_sql((term,)).replace("c AS (", f"c{i} AS (", 1).replace("FROM c)", f"FROM c{i})").replace("st AS (", f"st{i} AS (").replace("b AS (", f"b{i} AS (").replace("FROM c, st", f"FROM c{i}, st{i}")
        ctes.append(inner)
        parts.append(f"SELECT {i} AS run_no, 'lexical' AS channel, doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b{i}) WHERE rank <= 40")
    ctes.append(_DENSE)
    parts.append(f"SELECT {len(TERMS)}, 'dense', doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM dn) WHERE rank <= 40 AND doc_id IN (SELECT doc_id FROM documents)")
    return ", ".join(ctes) + ", runs AS (" + " UNION ALL ".join(parts) + ")"


_FUSED = _runs_sql() + ", fu AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM runs GROUP BY doc_id)"


@query("x01_search_runs", f"WITH {_runs_sql()} SELECT run_no, channel, doc_id, rank FROM runs")
def x01(t):
    return _runs(t)


@query("a10_rank_fusion", f"WITH {_FUSED} SELECT doc_id, score, channels FROM fu")
def a10(t):
    return R.fused(_runs(t))


_SEATED = _FUSED + ", se AS (SELECT doc_id, min(rank * 100 + run_no) AS seat FROM runs WHERE rank <= 2 GROUP BY doc_id), od AS (SELECT fu.doc_id, score, channels, row_number() OVER (ORDER BY seat IS NULL, seat, score DESC, fu.doc_id) AS pos FROM fu LEFT JOIN se USING (doc_id))"


@query("w03_seat_rounds", f"WITH {_SEATED} SELECT doc_id, score, channels, pos FROM od")
def w03(t):
    runs = _runs(t)
    return R.seated(runs, R.fused(runs))


_CAPPED = _SEATED + ", ow AS (SELECT od.*, source, row_number() OVER (PARTITION BY source ORDER BY pos, od.doc_id) > 6 AS over FROM od JOIN documents USING (doc_id)), cp AS (SELECT doc_id, score, channels, source, row_number() OVER (ORDER BY over, pos, doc_id) AS pos FROM ow)"


@query("k09_hybrid_search", f"WITH {_CAPPED} SELECT doc_id, score, channels, source, pos FROM cp WHERE pos <= 24")
def k09(t):
    """The flagship: lexical and dense runs, fused, seated, capped by source, cut at the depth."""
    runs = _runs(t)
    owned = R.seated(runs, R.fused(runs)).join(t("documents").select("doc_id", "source"), "doc_id")
    return R.capped(owned, "source").where(F.col("pos") <= R.DEPTH)


@query("w02_source_cap", f"WITH {_CAPPED} SELECT doc_id, source, pos FROM cp")
def w02(t):
    runs = _runs(t)
    owned = R.seated(runs, R.fused(runs)).join(t("documents").select("doc_id", "source"), "doc_id")
    return R.capped(owned, "source").select("doc_id", "source", "pos")


@query("w08_governing_seats", f"""WITH {_CAPPED},
br AS (SELECT doc_id, min(rank) AS best_rank FROM runs GROUP BY doc_id),
gov AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 6),
re AS (SELECT cp.*, row_number() OVER (PARTITION BY cp.source ORDER BY best_rank NULLS LAST, pos, cp.doc_id) AS n FROM cp JOIN gov USING (source) LEFT JOIN br USING (doc_id) WHERE pos > 24)
SELECT doc_id, source, pos, 'depth' AS seat FROM cp WHERE pos <= 24 UNION ALL SELECT doc_id, source, pos, 'governing' FROM re WHERE n <= 6""")
def w08(t):
    runs = _runs(t)
    docs = t("documents").select("doc_id", "source")
    ordered = R.capped(R.seated(runs, R.fused(runs)).join(docs, "doc_id"), "source").select("doc_id", "source", "pos")
    governing = docs.groupBy("source").count().orderBy(F.desc("count"), "source").limit(R.GOVERNING)
    return R.governing_seats(ordered, governing, runs.groupBy("doc_id").agg(F.min("rank").alias("best_rank")))


@query("a11_eligible_fusion", f"WITH {_FUSED}, el AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 4 ELSE 3 END AS n_runs FROM documents) SELECT doc_id, round(score / n_runs, 8) AS score, channels, n_runs FROM fu JOIN el USING (doc_id)")
def a11(t):
    has = t("embeddings").select(F.col("vec_id").alias("doc_id")).withColumn("has", F.lit(True))
    eligible = t("documents").select("doc_id").join(has, "doc_id", "left").select("doc_id", F.when(F.col("has"), 4).otherwise(3).alias("n_runs"))
    return R.eligible_fusion(_runs(t), eligible)


@query("a12_best_per_label", f"WITH {_DENSE} SELECT label, max(score) AS score, min(doc_id) AS vec_id FROM (SELECT label, doc_id, score, max(score) OVER (PARTITION BY label) AS best FROM dn JOIN embeddings ON vec_id = doc_id) WHERE score = best GROUP BY label")
def a12(t):
    scored = t("embeddings").select("label", "vec_id", F.round(R.inner(F.col("embedding"), _query_vector(t)), 6).alias("score"))
    return scored.groupBy("label").agg(F.min(F.struct(-F.col("score"), "vec_id")).alias("x")).select("label", (-F.col("x.col1")).alias("score"), "x.vec_id")


@query("o02_adaptive_depth", "SELECT source, count(*) AS n, CAST(round(24 * least(2.0, greatest(1.0, sqrt(count(*) * 1000 / 19000.0)))) AS INTEGER) AS depth, CAST(round(40 * least(2.0, greatest(1.0, sqrt(count(*) * 1000 / 19000.0)))) AS INTEGER) AS per_query FROM documents GROUP BY source")
def o02(t):
    n = F.col("n") * 1000
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", "n", R.adaptive_depth(n, 24).alias("depth"), R.adaptive_depth(n, 40).alias("per_query"))


@query("o01_top_titles", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def o01(t):
    return t("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "p_name", "p_retailprice")


@query("a07_title_idf", """
WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS term FROM part), n AS (SELECT count(*) AS n FROM part)
SELECT term, count(*) AS df, round(ln(1 + any_value(n) / count(*)), 6) AS idf FROM w, n WHERE length(term) >= 3 GROUP BY term""")
def a07(t):
    words = F.explode(F.array_distinct(F.split(F.lower("p_name"), "[^a-z0-9]+")))
    n = t("part").count()
    return t("part").select(words.alias("term")).where(F.char_length("term") >= 3).groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.round(R.idf_plus(F.lit(float(n)), F.col("df")), 6))


@query("k06_title_lexical", """
WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS term FROM part), n AS (SELECT count(*) AS n FROM part),
i AS (SELECT term, ln(1 + any_value(n) / count(*)) AS idf FROM w, n WHERE length(term) >= 3 GROUP BY term),
q AS (SELECT term, idf FROM i ORDER BY idf DESC, term LIMIT 5)
SELECT p_partkey, round(sum(idf), 6) AS score FROM w JOIN q USING (term) GROUP BY p_partkey""")
def k06(t):
    words = t("part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), "[^a-z0-9]+"))).alias("term")).where(F.char_length("term") >= 3)
    n = t("part").count()
    idf = words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", R.idf_plus(F.lit(float(n)), F.col("df")).alias("idf"))
    asked = idf.orderBy(F.desc("idf"), "term").limit(5)
    return words.join(F.broadcast(asked), "term").groupBy("p_partkey").agg(F.round(F.sum("idf"), 6).alias("score"))


@query("w16_primary_share", """
WITH o AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
a AS (SELECT p_partkey, row_number() OVER (ORDER BY rank) AS r FROM o WHERE p_brand LIKE '%1'),
u AS (SELECT p_partkey, 0 AS src, r AS rank FROM a WHERE r <= 12 UNION ALL SELECT p_partkey, 1, rank FROM o),
d AS (SELECT p_partkey, min(src * 1000000 + rank) AS k FROM u GROUP BY p_partkey)
SELECT p_partkey, row_number() OVER (ORDER BY k) AS pos FROM d QUALIFY pos <= 25""")
def w16(t):
    """Half of the list from the ranking of one kind alone, then the open ranking without repeats."""
    best = Window.orderBy(F.desc("p_retailprice"), "p_partkey")
    top = t("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25 + 12)
    kind = t("part").where(F.col("p_brand").endswith("1")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(12)
    both = kind.select("p_partkey", F.lit(0).alias("src"), F.row_number().over(best).alias("rank")).unionByName(top.select("p_partkey", F.lit(1).alias("src"), F.row_number().over(best).alias("rank")))
    once = both.groupBy("p_partkey").agg(F.min(F.struct("src", "rank")).alias("k"))
    return once.select("p_partkey", F.row_number().over(Window.orderBy("k")).alias("pos")).where("pos <= 25")
