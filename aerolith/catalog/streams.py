"""Structured Streaming operators over the events table, run as one bounded stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.catalog import query, table
from aerolith.streaming import windows


@query("""SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, round(CASE WHEN count(value) >= 16 THEN avg(value) END, 6) AS mean, min(value) AS min, max(value) AS max, count(value) AS n_valid, count(value) >= 16 AS meets_threshold FROM events GROUP BY 1, 2""")
def windowed_daily(spark, d):
    out = windows.gated_windows(table(spark, d, "events"), ["event_type"], "ts", "value")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM r GROUP BY user_id, k""")
def sessions(spark, d):
    out = windows.sessions(table(spark, d, "events"), ["user_id"], "ts", "6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT max(ts) AS latest, CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', max(ts)))) / 3600) AS BIGINT) AS lag_hours FROM events")
def freshness(spark, d):
    return windows.freshness(table(spark, d, "events"), "ts", "2024-02-01")
