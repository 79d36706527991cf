"""The register shortlist over the documents: an owner is a source in one language, its title its first document's first line.

The other documents' first lines are its headings; vectors are those of ``embeddings`` by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import shortlist as S

#: The questions' terms; each has the vector of one of the smallest ids.
TERMS = [["tion", "the"], ["und", "eau", "ción"]]


def _register(t) -> tuple[DataFrame, DataFrame]:
    """(owner, title, kind, vector) and (owner, heading, ordinal, vector)."""
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    nth = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    heads = t("documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("owner"), F.col("lang").alias("kind"), "source", "lang", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("line")).withColumn("_n", nth).drop("source", "lang").join(vectors, "doc_id", "left")
    titles = heads.where("_n = 1").select("owner", F.col("line").alias("title"), "kind", "vector")
    return titles, heads.where("_n > 1").select("owner", F.col("line").alias("heading"), F.col("doc_id").alias("ordinal"), "vector")


def _questions(t) -> list[tuple[list[str], list[float]]]:
    rows = t("embeddings").orderBy("vec_id").limit(len(TERMS)).select("embedding").collect()  # a vector a question
    return [(terms, [float(x) for x in r["embedding"]]) for terms, r in zip(TERMS, rows)]


_BASE = """
hh AS (SELECT source || '/' || lang AS owner, lang AS kind, doc_id, split_part(text, chr(10), 1) AS line, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn, CAST(embedding AS DOUBLE[]) AS v
       FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
vv AS (SELECT owner, v FROM hh WHERE rn = 1 AND v IS NOT NULL UNION ALL
       SELECT owner, v FROM (SELECT owner, v, row_number() OVER (PARTITION BY owner ORDER BY doc_id) AS n FROM hh WHERE rn > 1 AND v IS NOT NULL) WHERE n <= 24),
cp AS (SELECT owner, place, avg(x) AS x FROM (SELECT owner, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM vv) GROUP BY owner, place),
ov AS (SELECT owner, list(x / norm ORDER BY place) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY owner)) AS norm FROM cp) GROUP BY owner),
tm(no, term) AS (VALUES (0, 'tion'), (0, 'the'), (1, 'und'), (1, 'eau'), (1, 'ción')),
qv AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS no, CAST(embedding AS DOUBLE[]) AS q FROM embeddings QUALIFY no < 2)"""


def _channels_sql(tag: str, kind: str | None) -> str:
    own = f"WHERE kind = '{kind}' AND" if kind else "WHERE"
    return f"""
ti{tag} AS (SELECT owner, line FROM hh {own} rn = 1), hd{tag} AS (SELECT owner, doc_id, line, v FROM hh {own} rn > 1),
it{tag} AS (SELECT term, ln(1 + (SELECT count(*) FROM ti{tag}) / count(*)) AS w FROM ti{tag} JOIN (SELECT DISTINCT term FROM tm) ON contains(lower(line), term) GROUP BY term),
ih{tag} AS (SELECT term, ln(1 + (SELECT count(DISTINCT owner) FROM hd{tag}) / count(DISTINCT owner)) AS w FROM hd{tag} JOIN (SELECT DISTINCT term FROM tm) ON contains(lower(line), term) GROUP BY term),
s{tag} AS (
  SELECT no, 0 AS c, owner, round(sum(w), 8) AS score, NULL AS matched FROM ti{tag} JOIN tm ON contains(lower(line), term) JOIN it{tag} USING (term) GROUP BY no, owner
  UNION ALL SELECT no, 1, owner, round(list_inner_product(v, q), 8), NULL FROM ov SEMI JOIN ti{tag} USING (owner), qv
  UNION ALL SELECT no, 2, owner, score, lower(line) FROM (SELECT no, owner, doc_id, line, round(sum(w), 8) AS score FROM hd{tag} JOIN tm ON contains(lower(line), term) JOIN ih{tag} USING (term) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY no, owner ORDER BY score DESC, doc_id) = 1
  UNION ALL SELECT no, 3, owner, score, line FROM (SELECT no, owner, doc_id, line, round(list_inner_product(v, q), 8) AS score FROM hd{tag}, qv WHERE v IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY no, owner ORDER BY score DESC, doc_id) = 1),
ch{tag} AS (SELECT no * 4 + c AS run_no, CASE c WHEN 0 THEN 'title-lexical' WHEN 1 THEN 'title-dense' WHEN 2 THEN 'heading-lexical' ELSE 'heading-dense' END AS channel, owner, row_number() OVER (PARTITION BY no, c ORDER BY score DESC, owner) AS rank, matched FROM s{tag} QUALIFY rank <= 40)"""


def _pool_sql(tag: str, limit: int) -> str:
    return f"""
el{tag} AS (SELECT count(DISTINCT run_no) FILTER (NOT starts_with(channel, 'heading')) AS t, count(DISTINCT run_no) FILTER (starts_with(channel, 'heading')) AS h FROM ch{tag}),
fu{tag} AS (SELECT owner, round(sum(1.0::DOUBLE / (60 + rank)) / greatest(any_value(t) + CASE WHEN owner IN (SELECT owner FROM hh WHERE rn > 1) THEN any_value(h) ELSE 0 END, 1), 8) AS score,
   string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, list(matched ORDER BY rank, run_no) FILTER (matched IS NOT NULL) AS why FROM ch{tag}, el{tag} GROUP BY owner),
po{tag} AS (SELECT owner, channels, why, row_number() OVER (ORDER BY score DESC, owner) AS rank FROM fu{tag} QUALIFY rank <= {limit})"""


@query("k05_owner_vectors", f"WITH {_BASE} SELECT owner, unnest(list_transform(v, lambda x: round(x, 6))) AS x, generate_subscripts(v, 1) AS component FROM ov")
def k05(t):
    """The vector of each owner: its title and at most 24 headings, averaged, at length one."""
    titles, headings = _register(t)
    return S.owner_vectors(titles, headings).select("owner", F.posexplode("vector").alias("component", "x")).select("owner", F.round("x", 6).alias("x"), (F.col("component") + 1).alias("component"))


@query("k07_four_channels", f"WITH {_BASE}, {_channels_sql('', None)} SELECT run_no, channel, owner, rank, matched FROM ch")
def k07(t):
    titles, headings = _register(t)
    return S.channel_runs(titles, headings, S.owner_vectors(titles, headings), _questions(t))


@query("k07_kind_before_top", f"WITH {_BASE}, {_channels_sql('', 'fr')} SELECT run_no, channel, owner, rank, matched FROM ch")
def k07_kind(t):
    """The kind is filtered before anything is counted or ranked, so the lists are full of that kind."""
    titles, headings = _register(t)
    return S.channel_runs(titles, headings, S.owner_vectors(titles, headings), _questions(t), kind="fr")


@query("k08_register_shortlist", f"""WITH {_BASE}, {_channels_sql('', None)}, {_pool_sql('', 25)}, {_channels_sql('k', 'en')}, {_pool_sql('k', 12)},
un AS (SELECT owner, channels, why, row_number() OVER (ORDER BY l, rank) AS rank FROM (SELECT 0 AS l, * FROM pok UNION ALL SELECT 1, * FROM po WHERE owner NOT IN (SELECT owner FROM pok)))
SELECT owner, rank, channels, why[1] AS first_heading FROM un WHERE rank <= 25""")
def k08(t):
    """Four channels fused and normalised, over-fetched, half of the list held for one kind."""
    titles, headings = _register(t)
    headings = S.written(headings)
    vectors = S.written(S.owner_vectors(titles, headings))
    return S.shortlist(titles, headings, vectors, _questions(t), primary="en").select("owner", "rank", "channels", F.get("matched_headings", F.lit(0)).alias("first_heading"))
