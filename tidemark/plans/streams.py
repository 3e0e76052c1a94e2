"""X-: windows over the event table, the same functions that streams use."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.base import query, table
from tidemark.streaming import streams


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL""")
def x01_tumbling_window(spark, sf):
    got = streams.tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"])
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.round("total", 4) + 0.0).alias("total"))


@query("""SELECT s.start, event_type, count(*) AS n FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) s GROUP BY ALL""")
def x09_sliding_window(spark, sf):
    got = streams.tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], slide="30 minutes")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM s GROUP BY user_id, sid""")
def x02_session_window(spark, sf):
    got = streams.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ["user_id"])
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", (F.round("total", 4) + 0.0).alias("total"))


@query("""SELECT p.event_id, r.event_id AS result_id FROM events p LEFT JOIN events r ON p.event_type = 'click' AND r.event_type = 'purchase' AND r.user_id = p.user_id AND r.ts >= p.ts AND r.ts <= p.ts + INTERVAL 1 DAY WHERE p.event_type = 'click'""")
def x06_attached_results(spark, sf):
    e = table(spark, sf, "events")
    p = e.filter("event_type = 'click'").select("event_id", "user_id", F.col("ts").alias("made"))
    r = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("result_id"), F.col("ts").alias("known"))
    return streams.attach_results(p, r, "user_id", "made", "known", "1 day").select("event_id", "result_id")


@query("""SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY ALL""")
def x05_deduplicated_events(spark, sf):
    e = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    return streams.deduplicated(e, "ts", ["user_id", "event_type", "d"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
