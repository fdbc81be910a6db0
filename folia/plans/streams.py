"""Streams over the event table, drained so that a batch query can check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import live
from .base import load, query


@query("""SELECT event_id AS seq, 'f' || user_id AS file, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'processed' END AS action, CASE
   WHEN event_type = 'error' THEN coalesce(props, '') ELSE '' END AS error FROM events""")
def live_report_stream(spark, sf_dir):
    """One row for each finished file, in micro-batches, each written whole."""
    failed = F.col("event_type") == "error"
    rows = live.events_stream(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.concat(F.lit("f"), F.col("user_id")).alias("file"),
            F.when(failed, "FAILED").otherwise("processed").alias("action"), F.when(failed,
            F.coalesce("props", F.lit(""))).otherwise("").alias("error"))
    return live.live_report(rows)


@query("""WITH e AS (SELECT user_id AS file, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS t
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(t) OVER (PARTITION BY file ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
 SELECT file, min(ts) AS began, max(ts) + INTERVAL 1 HOUR AS stalled_at, count(*) AS reports, max(value) AS furthest FROM s GROUP BY file, n
   HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def stall_watchdog(spark, sf_dir):
    """Sessions of each user's events that ended an hour or more before the last event of all."""
    rows = live.events_stream(spark, sf_dir).select(F.col("user_id").alias("file"), F.col("ts").cast("timestamp").alias("ts"), "value")
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return live.watched(rows).select("file", plain("began"), plain("stalled_at"), "reports", "furthest")


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_event_counts(spark, sf_dir):
    """Tumbling windows of a day."""
    e = load(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return e.select("event_type", F.col("w.start").alias("day"), "n")
