"""Orders within groups: latest states, forward fills, round-robins, natural sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import ledger as L
from ..operators import ordering as O


def _w(by: str, *order):
    return Window.partitionBy(by).orderBy(*order)


@query("w04_newest_answer", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def w04(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("w05_latest_verdict", "SELECT conv_id, arg_max(role, turn) AS verdict, max(turn) AS turn FROM conversations GROUP BY conv_id")
def w05(t):
    return t("conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("verdict"), F.max("turn").alias("turn"))


@query("w06_history_with_previous", "SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events")
def w06(t):
    return t("events").select("event_id", "user_id", "event_type", F.lag("event_type").over(_w("user_id", "event_id")).alias("before"))


@query("w07_newest_per_key", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def w07(t):
    return L.last_wins(t("events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("w09_heading_carried", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations")
def w09(t):
    w = _w("conv_id", "turn").rowsBetween(Window.unboundedPreceding, 0)
    return t("conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("heading"))


@query("w10_running_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM conversations")
def w10(t):
    return L.with_offsets(t("conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "char_start")


_LISTS = "(SELECT doc_id, 0 AS src, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 30 UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY n_chars, doc_id) FROM documents WHERE lang = 'en' QUALIFY row_number() OVER (ORDER BY n_chars, doc_id) <= 30 UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM documents WHERE lang = 'de' QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 30)"


@query("w11_round_robin", f"SELECT doc_id, row_number() OVER (ORDER BY min(r * 10 + src)) AS pos FROM {_LISTS} GROUP BY doc_id")
def w11(t):
    d = t("documents").select("doc_id", "n_chars", "lang")
    shortest = d.where("lang = 'en'").withColumn("less", -F.col("n_chars"))
    return L.interleaved([L.top(d, "n_chars", "doc_id", 30), L.top(shortest, "less", "doc_id", 30), L.top(d.where("lang = 'de'"), "n_chars", "doc_id", 30)], "doc_id")


@query("w12_crawl_order", """
WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, source, row_number() OVER (ORDER BY rn, source, doc_id) AS pos FROM k WHERE rn <= 40""")
def w12(t):
    """Children a round at a time, at most 40 of a parent."""
    k = t("documents").select("doc_id", "source").withColumn("rn", F.row_number().over(_w("source", "doc_id"))).where("rn <= 40")
    return k.select("doc_id", "source", F.row_number().over(Window.orderBy("rn", "source", "doc_id")).alias("pos"))


@query("w13_version_choice", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, (p_type LIKE 'PROMO%'), p_partkey) = 1")
def w13(t):
    return t("part").withColumn("rn", F.row_number().over(_w("p_brand", F.desc("p_size"), F.col("p_type").startswith("PROMO"), "p_partkey"))).where("rn = 1").select("p_brand", "p_partkey")


@query("w14_review_queue", "SELECT doc_id, row_number() OVER (ORDER BY quality, toxic DESC, source, doc_id) AS pos FROM labels JOIN documents USING (doc_id) QUALIFY pos <= 100")
def w14(t):
    d = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").orderBy("quality", F.desc("toxic"), "source", "doc_id").limit(100)
    return d.select("doc_id", F.row_number().over(Window.orderBy("quality", F.desc("toxic"), "source", "doc_id")).alias("pos"))


@query("w17_current_phase", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'login' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phase FROM events")
def w17(t):
    w = _w("user_id", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "login", F.col("event_id")), ignorenulls=True).over(w).alias("phase"))


@query("w_median_last_40", "SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), 6) AS typical FROM events")
def w_median(t):
    return t("events").select("event_id", F.round(F.percentile("value", 0.5).over(_w("user_id", "event_id").rowsBetween(-39, 0)), 6).alias("typical"))


@query("o03_natural_order", "WITH i AS (SELECT DISTINCT substr(source, 4) || '.' || (n_chars % 13) AS id FROM documents) SELECT id, row_number() OVER (ORDER BY CAST(split_part(id, '.', 1) AS INTEGER), CAST(split_part(id, '.', 2) AS INTEGER), id) AS pos FROM i")
def o03(t):
    """"10.1" stands behind "6.2": all parts are compared as numbers, then the id as it is."""
    ids = t("documents").select(F.concat(F.substring("source", 4, 9), F.lit("."), F.col("n_chars") % 13).alias("id")).distinct()
    parts = F.transform(F.split("id", r"\."), lambda x: x.cast("int"))
    return ids.select("id", F.row_number().over(Window.orderBy(parts, "id")).alias("pos"))  # distinct ids are few


@query("o05_longest_first", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS size, row_number() OVER (ORDER BY sum(n_chars) DESC, source) AS pos FROM documents GROUP BY source")
def o05(t):
    units = t("documents").groupBy("source").agg(F.sum("n_chars").alias("size"))
    return units.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("size"), "source")))


@query("o06_page", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def o06(t):
    return t("documents").select("doc_id").orderBy("doc_id").offset(40).limit(20)


@query("o07_best_per_owner", "WITH b AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE lang = 'en') SELECT doc_id, source, n_chars FROM b WHERE rn = 1 ORDER BY n_chars DESC, doc_id LIMIT 12")
def o07(t):
    b = t("documents").where("lang = 'en'").groupBy("source").agg(F.min(F.struct(-F.col("n_chars"), "doc_id")).alias("x"))
    return b.select("x.doc_id", "source", (-F.col("x.col1")).alias("n_chars")).orderBy(F.desc("n_chars"), "doc_id").limit(12)


@query("o04_governing_first", "SELECT doc_id, row_number() OVER (ORDER BY CASE source WHEN 'src2' THEN 1 WHEN 'src5' THEN 2 ELSE 999 END, doc_id) AS pos FROM documents")
def o04(t):
    rank = F.when(F.col("source") == "src2", 1).when(F.col("source") == "src5", 2).otherwise(999)
    return O.positions(t("documents").select("doc_id", rank.alias("rank")), "rank", "doc_id").select("doc_id", "pos")
