"""Items materialised from the events: an item is a user, an attempt an event, its kind what came of it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..catalog import query
from ..streaming import materialise as M

WAIT = timedelta(hours=6)


@query("n01_materialised", """
WITH a AS (SELECT user_id AS item, event_id, epoch_ms(ts) AS ms, CASE event_type WHEN 'error' THEN 'parse-error' WHEN 'view' THEN 'empty' WHEN 'signup' THEN 'forbidden' ELSE 'read' END AS kind FROM events WHERE user_id IS NOT NULL),
n AS (SELECT *, row_number() OVER w AS k, ms > lag(ms) OVER w + 21600000 AS late FROM a WINDOW w AS (PARTITION BY item ORDER BY ms, event_id)),
f AS (SELECT item, min(k) FILTER (late) AS gap, min(k) FILTER (kind IN ('forbidden', 'read')) AS fin, count(*) AS n FROM n GROUP BY item),
c AS (SELECT item, CASE WHEN coalesce(gap, 9) <= least(coalesce(fin, 9), 3) THEN gap - 1 ELSE least(coalesce(fin, 9), 3, n) END AS attempts, coalesce(gap, 9) <= least(coalesce(fin, 9), 3) AS expired FROM f)
SELECT c.item, CAST(c.attempts AS INTEGER) AS attempts, CASE WHEN expired THEN 'expired' WHEN kind IN ('forbidden', 'read') THEN kind WHEN c.attempts = 3 THEN 'gave up: ' || kind ELSE 'expired' END AS outcome
FROM c JOIN n ON n.item = c.item AND n.k = c.attempts
WHERE expired OR kind IN ('forbidden', 'read') OR c.attempts = 3 OR ms + 21600000 <= (SELECT max(ms) FROM a)""")
def n01(t):
    """Users' events as attempts that arrive in three batches, in the order of time; which items are closed, how, and after how many."""
    e = t("events").select(F.col("user_id").alias("item"), F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "parse-error").when(F.col("event_type") == "view", "empty").when(F.col("event_type") == "signup", "forbidden").otherwise("read").alias("kind"))
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    if span["a"] is None:
        return M.in_batches(e.sparkSession, [e], WAIT).drop("at")
    third = (span["b"] - span["a"]) / 3
    cuts = [span["a"] + third, span["a"] + 2 * third]
    parts = [e.where(F.col("ts") < F.lit(cuts[0])), e.where(F.col("ts").between(F.lit(cuts[0]), F.lit(cuts[1]))), e.where(F.col("ts") > F.lit(cuts[1]))]
    return M.in_batches(e.sparkSession, parts, WAIT).drop("at")
