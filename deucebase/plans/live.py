"""Feed-style queries over the events table, and draw scaffolds."""

from __future__ import annotations

from pyspark.sql import functions as F

from deucebase.operators import live
from deucebase.plans.registry import query
from deucebase.sources.adapter import matches


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id", "")
def last_states(spark, d):
    e = _events(spark, d).withColumn("at", F.struct("ts", "event_id"))
    return live.last_state(e, ["user_id"], "at", ["event_type"]).select("user_id", F.col("at.ts").alias("ts"), "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 2", "")
def pruned_history(spark, d):
    return live.prune(_events(spark, d), ["user_id"], "ts", 2, "event_id").select("user_id", "event_id")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, user_id FROM events e WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 3 = 0 AND s.user_id = e.user_id AND s.event_type = e.event_type)", "")
def archived_once(spark, d):
    e = _events(spark, d).select("event_id", "user_id", "event_type")
    return live.archive(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), ["user_id", "event_type"]).select("event_id", "user_id")


@query(", dr AS (SELECT DISTINCT year, gender, 8 AS size FROM matches), r AS (SELECT *, unnest(range(1, 4)) AS round FROM dr), s AS (SELECT *, unnest(range(1, (8 / pow(2, round))::BIGINT + 1)) AS slot FROM r) SELECT year::INT AS year, gender, round::INT AS round, slot, floor((slot + 1) / 2)::BIGINT AS feeds FROM s")
def draw_scaffold(spark, d):
    return live.slots(matches(spark, d).select("year", "gender", F.lit(8).alias("size")), ["year", "gender"], "size").select("year", "gender", "round", "slot", "feeds")


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2", "")
def daily_events(spark, d):
    return _events(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2", "")
def first_events(spark, d):
    """The first event of each user and kind: first per key by a full order."""
    return live.first_per_key(_events(spark, d), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")
