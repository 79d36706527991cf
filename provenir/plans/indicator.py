"""Retrieval for an indicator over the documents: sections are documents, instruments their sources.

A section's label is its number of lines, its heading the first of them; an instrument states
something of itself where ``labels`` calls the document good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import indicator as I
from ..operators import suppression as S

#: The questions in the rubric's language, and those that are asked again in others.
ENGLISH, RENDERED = [["tion"], ["the and", "licen"]], [["heit"], ["ción", "ement"]]
#: What points (a licence line), what states the matter (a number), what names measure and code.
LEAVES, STATES, MEASURE, CODE = r"(?i)\blicensed under\b", r"[0-9]{16}|\+1 \([0-9]{3}\)", r"(?i)\b(the|und|les|los)\b", r"[0-9]{16}"


def _sections(t) -> DataFrame:
    good = t("labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("stands"))
    d = t("documents").join(good, "doc_id", "left")
    body = F.coalesce("text", F.lit(""))
    return d.select("doc_id", "source", "lang", "text", F.size(F.split(body, "\n")).alias("label"), F.split_part(body, F.lit("\n"), F.lit(1)).alias("heading"), F.md5("text").alias("digest"), F.char_length(body).alias("length"), F.coalesce("stands", F.lit(False)).alias("stands"))


_J14 = r"""
s AS (SELECT doc_id, source, lang, len(string_split(text, chr(10))) AS label, length(text) AS n,
        list_filter(list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)*[A-Z]{0,2}\b')), lambda f: f <> CAST(len(string_split(text, chr(10))) AS VARCHAR)) AS f
      FROM documents),
ow AS (SELECT * FROM s WHERE lang = 'en'),
ot AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY doc_id) AS k FROM s WHERE lang <> 'en'),
ed AS (SELECT ot.doc_id, list({'c': ow.doc_id, 'v': CASE WHEN len(ot.f) = 0 THEN 0 ELSE len(list_intersect(ot.f, ow.f)) / (len(ot.f) + len(ow.f) - len(list_intersect(ot.f, ow.f))) END}) AS e
       FROM ot JOIN ow USING (source, label)
       WHERE ot.n BETWEEN 0.5 * greatest(ow.n, 1) AND 2.2 * greatest(ow.n, 1)
         AND (len(ot.f) + len(ow.f) = 0 OR len(list_intersect(ot.f, ow.f)) >= 0.5 * (len(ot.f) + len(ow.f) - len(list_intersect(ot.f, ow.f))))
       GROUP BY ot.doc_id),
nr AS (SELECT source, label, count(*) AS m FROM ow GROUP BY ALL),
walk AS (
  SELECT source, label, m, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS doc_id, NULL::BIGINT AS original FROM nr
  UNION ALL
  SELECT source, label, m, k, CASE WHEN original IS NULL THEN taken ELSE list_append(taken, original) END, doc_id, original
  FROM (SELECT source, label, m, k, taken, doc_id,
          CASE WHEN len(top) = 1 THEN top[1].c END AS original
        FROM (SELECT *, list_filter(live, lambda x: x.v = list_max(list_transform(live, lambda y: y.v))) AS top
              FROM (SELECT w.source, w.label, w.m, ot.k, w.taken, ot.doc_id,
                      list_filter(coalesce(ed.e, []), lambda x: NOT list_contains(w.taken, x.c) AND (x.v > 0 OR w.m - len(w.taken) = 1)) AS live
                    FROM walk w JOIN ot ON ot.source = w.source AND ot.label = w.label AND ot.k = w.k + 1 LEFT JOIN ed ON ed.doc_id = ot.doc_id))))"""


@query("j14_translation_pairs", f"WITH RECURSIVE {_J14} SELECT doc_id, original FROM walk WHERE original IS NOT NULL")
def j14(t):
    return S.other_language_copies(_sections(t))


_WHY = r""",
b AS (SELECT d.doc_id, source, text, split_part(text, chr(10), 1) AS heading, md5(text) AS dg, coalesce(q.good, false) AS stands
      FROM documents d LEFT JOIN (SELECT doc_id, max(quality) = 1 AS good FROM labels GROUP BY doc_id) q USING (doc_id)),
ca AS (
  SELECT doc_id, 0 AS k, 'second-language' AS name FROM walk WHERE original IS NOT NULL
  UNION ALL SELECT doc_id, 1, 'outline' FROM b, (VALUES ('outline of this '), ('guide to this '), ('overview of this ')) AS o(lead), (VALUES ('part'), ('division'), ('chapter'), ('act'), ('schedule')) AS x(what)
    WHERE contains(lower(heading), lead || what) AND NOT (what = 'schedule' AND lead <> 'outline of this ') OR contains(lower(heading), 'simplified outline')
  UNION ALL SELECT doc_id, 2, 'second-registration' FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, dg ORDER BY stands DESC, doc_id) AS nth FROM b) WHERE nth > 1
  UNION ALL SELECT doc_id, 3, 'decided-case' FROM b WHERE (contains(lower(heading), 'notice') OR contains(lower(heading), 'notis') OR contains(lower(heading), 'notification'))
    AND (contains(lower(heading), 'investigation') OR contains(lower(heading), 'inquiry') OR contains(lower(heading), 'proceeding') OR contains(lower(heading), 'petition') OR contains(lower(heading), 'complaint') OR contains(lower(heading), 'review of'))
    AND (contains(lower(heading), 'in respect of') OR contains(lower(heading), 'in the matter of') OR contains(lower(heading), 'with regard to') OR contains(lower(heading), 'import'))),
kp AS (SELECT dg FROM b GROUP BY dg HAVING count(DISTINCT source) > 1 AND bool_or(stands AND doc_id NOT IN (SELECT doc_id FROM ca))),
cb AS (SELECT * FROM ca UNION SELECT doc_id, 4, 'repeated' FROM b SEMI JOIN kp USING (dg) WHERE NOT stands AND length(text) > 0),
wy AS (SELECT doc_id, arg_min(name, k) AS reason, string_agg(name, ',' ORDER BY k) AS reasons FROM (SELECT DISTINCT * FROM cb) GROUP BY doc_id)"""


def _suppressed(sections: DataFrame) -> DataFrame:
    causes = [
        ("second-language", lambda _: S.other_language_copies(sections)),
        ("outline", lambda _: S.outlines(sections)),
        ("second-registration", lambda _: S.second_registrations(sections)),
        ("decided-case", lambda _: S.decided_cases(sections)),
        ("repeated", lambda taken: S.repeated_provisions(sections, taken)),
    ]
    return S.cascade(causes, sections.select("doc_id").where("false"))


@query("k10_suppressed_sections", f"WITH RECURSIVE {_J14} {_WHY} SELECT doc_id, reason, reasons FROM wy")
def k10_suppressed(t):
    """Every suppressed section with the first of five causes, and all of them in order."""
    return _suppressed(_sections(t)).withColumn("reasons", F.array_join("reasons", ","))


def _runs_sql() -> str:
    terms = sorted({x for q in ENGLISH + RENDERED for x in q})
    name = {x: f"f{i}" for i, x in enumerate(terms)}
    counts = ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{x}', ''))) // {len(x)} AS {name[x]}" for x in terms)
    stats = ", ".join(f"count(*) FILTER ({f} > 0) AS n{f}" for f in name.values())
    out = [f"tc AS MATERIALIZED (SELECT doc_id, greatest(length(text) - 2, 0) AS d, {counts} FROM documents)", f"ts AS (SELECT count(*) AS n, avg(d) AS w, {stats} FROM tc)"]
    out.append("dp AS (SELECT round(24 * least(2, greatest(1, sqrt(n / 19000.0)))) AS seats, round(40 * least(2, greatest(1, sqrt(n / 19000.0)))) AS per FROM ts)")
    out.append("qv AS (SELECT embedding AS q, row_number() OVER (ORDER BY vec_id) - 1 AS no FROM embeddings QUALIFY no < 4)")
    out.append("dn AS (SELECT no, vec_id AS doc_id, row_number() OVER (PARTITION BY no ORDER BY round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 6) DESC, vec_id) AS rank FROM embeddings, qv WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY rank <= 80)")
    for no, q in enumerate(ENGLISH + RENDERED):
        score = " + ".join(f"greatest(ln((n - n{name[x]} + 0.5) / (n{name[x]} + 0.5)), CASE WHEN n - n{name[x]} > n{name[x]} THEN 0 ELSE 1e-6 END) * {name[x]} * 2.2 / ({name[x]} + 1.2 * (0.25 + 0.75 * d / w))" for x in q)
        some = " OR ".join(f"{name[x]} > 0" for x in q)
        out.append(f"lx{no} AS (SELECT doc_id, row_number() OVER (ORDER BY round({score}, 6) DESC, doc_id) AS rank FROM tc, ts WHERE {some})")
    return ", ".join(out)


def _search_sql(tag: str, first: int, last: int) -> str:
    """One search: runs, what is kept of them, fusion, seats, shares, depth, governing seats."""
    runs = " UNION ALL ".join(f"SELECT {2 * (no - first)} AS run, 'lexical' AS channel, doc_id, rank FROM lx{no} UNION ALL SELECT {2 * (no - first) + 1}, 'dense', doc_id, rank FROM dn WHERE no = {no}" for no in range(first, last))
    return f"""
r{tag} AS (SELECT * FROM ({runs}), dp WHERE rank <= per AND doc_id NOT IN (SELECT doc_id FROM wy)),
u{tag} AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, min(rank) AS best FROM r{tag} GROUP BY doc_id),
e{tag} AS (SELECT doc_id, min(nth * 100 + run) AS seat FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rank, doc_id) AS nth FROM r{tag}) WHERE nth <= 2 GROUP BY doc_id),
m{tag} AS (SELECT u.*, source, row_number() OVER (ORDER BY seat NULLS LAST, score DESC, u.doc_id) AS merit FROM u{tag} u LEFT JOIN e{tag} USING (doc_id) JOIN documents USING (doc_id)),
p{tag} AS (SELECT *, row_number() OVER (ORDER BY over, merit) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY merit) > 6 AS over FROM m{tag})),
g{tag} AS (SELECT p.*, place, row_number() OVER (PARTITION BY p.source ORDER BY best, merit) AS nth FROM p{tag} p JOIN go USING (source), dp WHERE pos > seats),
o{tag} AS (SELECT doc_id, channels, seat, row_number() OVER (ORDER BY a, b, c) AS rank FROM (
  SELECT doc_id, channels, 'depth' AS seat, 0 AS a, 0 AS b, pos AS c FROM p{tag}, dp WHERE pos <= seats
  UNION ALL SELECT doc_id, channels, 'governing', 1, place, nth FROM g{tag} WHERE nth <= 6))"""


_GOVERN = ", go AS (SELECT source, row_number() OVER (ORDER BY count(*) FILTER (stands) DESC, source) AS place FROM b GROUP BY source QUALIFY place <= 6)"

_BOTH = """
ap AS (SELECT doc_id, channels, seat, row_number() OVER (ORDER BY l, rank) AS rank FROM (SELECT 0 AS l, * FROM oa UNION ALL SELECT 1, * FROM ob WHERE doc_id NOT IN (SELECT doc_id FROM oa)))"""

_FOLLOW = r""",
cw AS (SELECT doc_id, source, text, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')), lambda w: w NOT IN ('that','this','which','with','from','have','been','shall','must','under','other','such','than','into','upon','where','there','their','these','those','within','made','being','does','section','paragraph','subsection','prescribed','amount')) AS words FROM documents),
pt AS (SELECT rank, source, strpos(lower(text), regexp_extract(lower(text), '\blicensed under\b')) AS spot, text FROM ap JOIN documents USING (doc_id) WHERE regexp_matches(lower(text), '\blicensed under\b')),
pc AS (SELECT rank, source, substr(text, greatest(spot - 400, 1)::BIGINT, least(spot - 1, 400)::BIGINT + 200) AS clause FROM pt),
pw AS (SELECT rank, source, list_filter(list_distinct(regexp_extract_all(lower(clause), '[a-z]{4,}')), lambda w: w NOT IN ('that','this','which','with','from','have','been','shall','must','under','other','such','than','into','upon','where','there','their','these','those','within','made','being','does','section','paragraph','subsection','prescribed','amount')) AS words,
         regexp_extract_all(clause, '\b[0-9]+[A-Z]?(?:\(\w+\))+') AS refs FROM pc),
tg AS (SELECT pw.rank, cw.doc_id, len(list_intersect(pw.words, cw.words)) AS shared, len(cw.words) AS size, len(list_filter(refs, lambda r: contains(cw.text, r))) > 0 AS cites
       FROM pw JOIN cw USING (source) WHERE regexp_matches(cw.text, '\d{16}|\+1 \(\d{3}\)') AND NOT regexp_matches(lower(cw.text), '\blicensed under\b') AND cw.doc_id NOT IN (SELECT doc_id FROM ap)),
tn AS (SELECT rank, doc_id, row_number() OVER (PARTITION BY rank ORDER BY cites DESC, shared / sqrt(greatest(size, 1)) DESC, doc_id) AS nth FROM tg WHERE shared >= 3 OR cites QUALIFY nth <= 8),
pi AS (SELECT rank, row_number() OVER (ORDER BY rank) AS i, list(doc_id ORDER BY nth) AS own FROM tn GROUP BY rank),
fw AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS had, NULL::BIGINT AS behind, []::BIGINT[] AS took
       UNION ALL SELECT i, list_concat(had, took), behind, took FROM (
         SELECT pi.i, list_concat(fw.had, []) AS had, pi.rank AS behind, list_slice(list_filter(pi.own, lambda x: NOT list_contains(fw.had, x)), 1, least(2, 6 - len(fw.had))) AS took FROM fw JOIN pi ON pi.i = fw.i + 1)),
fo AS (SELECT behind, unnest(took) AS doc_id, generate_subscripts(took, 1) AS nth FROM fw),
fa AS (SELECT doc_id, channels, seat, row_number() OVER (ORDER BY rank, n) AS rank FROM (SELECT doc_id, channels, seat, rank, 0 AS n FROM ap UNION ALL SELECT doc_id, 'prescribed-by', 'followed', behind, nth FROM fo)),
cs AS (SELECT doc_id, min(rank) AS best FROM (SELECT * FROM lx0 UNION ALL SELECT * FROM lx1 UNION ALL SELECT * FROM lx2 UNION ALL SELECT * FROM lx3) WHERE rank <= 3000 GROUP BY doc_id),
cf AS (SELECT arg_min(doc_id, best * 1000000000 + doc_id) AS doc_id, min(best * 1000000000 + doc_id) AS spot FROM cs JOIN documents USING (doc_id)
       WHERE doc_id NOT IN (SELECT doc_id FROM wy WHERE reasons <> 'decided-case') AND doc_id NOT IN (SELECT doc_id FROM fa) AND regexp_matches(lower(text), '\b(the|und|les|los)\b') AND regexp_matches(text, '\d{16}') GROUP BY source),
al AS (SELECT doc_id, rank, channels, seat FROM fa UNION ALL SELECT doc_id, (SELECT count(*) FROM fa) + row_number() OVER (ORDER BY spot), 'tariff-code', 'coded' FROM cf QUALIFY row_number() OVER (ORDER BY spot) <= 12)"""


@query("k10_indicator_retrieval", f"WITH RECURSIVE {_J14} {_WHY}, {_runs_sql()} {_GOVERN}, {_search_sql('a', 0, 2)}, {_search_sql('b', 2, 4)}, {_BOTH} {_FOLLOW} SELECT doc_id, rank, channels, seat FROM al")
def k10(t):
    """Suppression, the search asked twice (its second list only behind the first), what is followed, what a code names."""
    sections = I.written(_sections(t))
    why = I.written(_suppressed(sections))
    questions = ENGLISH + RENDERED
    size = sections.agg(F.count(F.lit(1)).alias("n"))
    seeds = [list(map(float, r["embedding"])) for r in t("embeddings").orderBy("vec_id").limit(len(questions)).select("embedding").collect()]  # a vector a question
    reach = I.written(I.lexical_runs(sections, questions, I.CODED_SCAN))
    vectors = t("embeddings").withColumnRenamed("vec_id", "doc_id").join(sections.select("doc_id"), "doc_id", "left_semi")
    near = I.written(I.dense_runs(vectors, seeds, 2 * I.R.PER_QUERY))
    owners = sections.select("doc_id", "source")
    most = sections.groupBy("source").agg(F.count_if("stands").alias("good")).orderBy(F.desc("good"), "source").limit(I.R.GOVERNING)
    governing = most.withColumn("place", F.row_number().over(I.Window.orderBy(F.desc("good"), "source")))
    lists = []
    for first, last in ((0, len(ENGLISH)), (len(ENGLISH), len(questions))):
        own = [r.where(F.col("run_no").between(first, last - 1)).withColumn("run_no", F.col("run_no") - first) for r in (reach.where(F.col("rank") <= 2 * I.R.PER_QUERY), near)]
        lists.append(I.written(I.seated_search(I.search_runs(*own), owners, governing, size, why)))
    both = I.written(S.appended(*lists))
    followed = I.written(I.prescribed(both, sections, leaves=LEAVES, states=STATES))
    so_far = I.written(I.answered(*lists, followed))
    skip = why.where("reasons != array('decided-case')")
    by_code = I.coded(reach, sections, so_far, skip, MEASURE, CODE)
    return I.answered(so_far, so_far.where("false"), None, by_code)
