"""The event ledger: streams that run over all that is there, and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import ORACLES, QUERIES, query
from ..streaming import events as E


def stream(name: str, sql: str | None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


@stream("e01_append_ledger", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view'")
def e01(spark, sf_dir):
    return E.drained(E.ledger(spark, sf_dir).where("event_type <> 'view'").select("event_id", "user_id", "event_type"))


@stream("e03_stage_windows", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS items, round(sum(value), 4) AS seconds FROM events GROUP BY ALL")
def e03(spark, sf_dir):
    out = E.drained(E.stage_totals(E.ledger(spark, sf_dir)), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "items", F.round("seconds", 4).alias("seconds"))


@stream("e04_progress_fold", "SELECT user_id, count(*) AS done, max(event_id) AS last_event FROM events GROUP BY user_id")
def e04(spark, sf_dir):
    return E.drained(E.progress(E.ledger(spark, sf_dir)), "update", ["user_id"])


@query("e02_tail_page", "SELECT event_id, event_type, event_id = max(event_id) OVER () AS done FROM (SELECT * FROM events WHERE event_id > 9900 ORDER BY event_id LIMIT 500)")
def e02(t):
    from ..operators import ledger as L

    page = L.tail(t("events"), "event_id", 9900, 500)
    return page.select("event_id", "event_type", (F.col("event_id") == F.max("event_id").over(Window.partitionBy())).alias("done"))


@query("e05_pacing_gaps", "SELECT user_id, count(*) AS n, count(*) FILTER (gap < 60) AS too_soon FROM (SELECT user_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events) GROUP BY user_id")
def e05(t):
    """Requests of one host that follow too soon."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    return t("events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("gap") < 60).alias("too_soon"))


@query("e06_resume", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def e06(t):
    """Units that are not done yet."""
    done = t("events").where("event_type = 'purchase'").select("user_id").distinct()
    return t("events").select("user_id").distinct().join(done, "user_id", "left_anti")


@query("x_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions FROM g GROUP BY user_id""")
def sessions(t):
    """An extension: sessions by gaps of event time."""
    return t("events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))
