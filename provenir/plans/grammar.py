"""Documents cut into sections by the grammar of their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..sources import grammar as G


@query("s20_sections_joined", "SELECT doc_id, md5(text) AS joined FROM documents")
def s20_joined(t):
    """The sections of each document, joined again, are its text."""
    each = F.array_sort(F.collect_list(F.struct("section", "text")))
    return G.sections(t("documents")).groupBy("doc_id").agg(F.md5(F.array_join(F.transform(each, lambda s: s["text"]), "\n")).alias("joined"))


@query("s20_sections", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
n AS (SELECT doc_id, i, CASE WHEN i % 12 = 0 THEN 'Part ' || (i // 12 + 1) WHEN i % 3 = 1 THEN i || '. of ' || x ELSE 'and ' || x END AS line FROM l),
o AS (SELECT *, count(*) FILTER (i % 12 = 0 OR i % 3 = 1) OVER (PARTITION BY doc_id ORDER BY i) AS section, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n)
SELECT doc_id, section, CASE WHEN min(i) % 12 = 0 THEN 'heading' ELSE 'provision' END AS kind, CASE WHEN min(i) % 12 > 0 THEN min(i)::VARCHAR END AS label,
  CASE WHEN min(i) = 0 THEN '' ELSE 'Part ' || ((min(i) - 1) // 12 + 1) END AS heading_path, CAST(min(start) AS BIGINT) AS start, md5(string_agg(line, chr(10) ORDER BY i)) AS text FROM o GROUP BY doc_id, section""")
def s20(t):
    """Documents whose lines are numbered as an Act's would be, every twelfth a part's: sections, numbers, headings above, places."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 12 == 0, F.concat(F.lit("Part "), (F.floor(i / 12) + 1).cast("string"))).when(i % 3 == 1, F.concat(i.cast("string"), F.lit(". of "), x)).otherwise(F.concat(F.lit("and "), x)))
    docs = t("documents").select("doc_id", F.array_join(numbered, "\n").alias("text"))
    return G.sections(docs, block=64).withColumn("text", F.md5("text"))
