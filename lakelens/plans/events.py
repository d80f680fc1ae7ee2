from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import windows
from .registry import query, table


@query("ag1_usage_by_type", "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY 1")
def by_type(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total"))


@query("ag2_usage_total", "SELECT coalesce(event_type, 'total') AS event_type, count(*) AS events, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY ROLLUP (event_type)")
def total(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total")).withColumn("event_type", F.coalesce("event_type", F.lit("total")))


@query("ag26_daily_change", """
WITH c AS (SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, lag(n) OVER (ORDER BY day) AS before, round((n - lag(n) OVER (ORDER BY day)) * 100.0::DOUBLE / lag(n) OVER (ORDER BY day), 4) AS change_pct FROM c""")
def daily(spark, d):
    """Counts are aggregated by day first; the window runs over days, not events."""
    c = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.orderBy("day"))
    return c.withColumn("before", before).withColumn("change_pct", F.round((F.col("n") - F.col("before")) * 100.0 / F.col("before"), 4))


@query("st1_routed_events", """
SELECT CASE WHEN event_type IN ('signup') THEN 'installation' WHEN event_type IN ('purchase') THEN 'push' WHEN event_type IN ('view', 'click') THEN 'pull_request' ELSE 'ignored' END AS route, count(*) AS events FROM events GROUP BY 1""")
def routed(spark, d):
    return table(spark, d, "events").groupBy(windows.route(F.col("event_type")).alias("route")).agg(F.count(F.lit(1)).alias("events"))


@query("st_tumbling_usage", """
SELECT date_trunc('day', ts) AS day, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling(spark, d):
    """A real stream over the event files, run until it has caught up, written and read back."""
    return windows.run_daily(spark, f"{d}/events.parquet").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "events", F.round("total", 4).alias("total"))


@query("st_session_usage", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    """Sessions of a user: events less than six hours apart."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    g = e.groupBy("user_id", F.session_window("t", "6 hours").alias("w")).agg(F.min("t").alias("first_ts"), F.max("t").alias("last_ts"), F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "events")
