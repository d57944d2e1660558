"""Streaming operators in their batch form, and as streams that read all there is and stop."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspur.plans.registry import query, table
from larkspur.streaming import jobs


_CALLS = "e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"
#: The first call of a user, and each next one that is late enough after the last such call.
_APART = """WITH RECURSIVE {calls}, a AS (SELECT user_id, r, ts FROM e WHERE r = 1 UNION ALL
SELECT user_id, r, ts FROM (SELECT e.user_id, e.r, e.ts, row_number() OVER (PARTITION BY e.user_id ORDER BY e.r) AS k FROM a JOIN e ON e.user_id = a.user_id AND e.r > a.r AND e.ts >= a.ts + INTERVAL {span}) WHERE k = 1)
SELECT event_id, user_id, {flag} FROM e LEFT JOIN a USING (user_id, r)"""


def _calls(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


@query(_APART.format(calls=_CALLS, span="24 hours", flag="a.r IS NOT NULL AS admitted"))
def rate_limiter(spark, sf):
    """A call a day and three in three days: the first rule implies the second."""
    return jobs.rate_limited(_calls(spark, sf), "user_id", "ts", "event_id", 1 / 86400, 3).select("event_id", "user_id", "admitted")


@query(_APART.format(calls=_CALLS, span="48 hours", flag="a.r IS NULL AS hit"))
def cache_hits(spark, sf):
    """Events as requests for a user's drawing, which is kept for two days."""
    return jobs.cache_replay(_calls(spark, sf), "user_id", "ts", "event_id", "48 hours").select("event_id", "user_id", "hit")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) AS start_us, event_type, count(*) AS events FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.windowed_counts(rows, "ts", "event_type").select(F.unix_micros("start").alias("start_us"), "event_type", "events")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) AS start_us, event_type, count(*) AS events FROM events GROUP BY ALL")
def windowed_counts_stream(spark, sf):
    """The same counts from a stream over the table's file, in complete mode."""
    source = table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"))
    name = f"counts_{uuid.uuid4().hex}"
    counts.select(F.unix_micros("window.start").alias("start_us"), "event_type", "events").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("SELECT user_id, sha256('{\"ids\":[' || string_agg(DISTINCT '\"' || event_type || '\"', ',' ORDER BY '\"' || event_type || '\"') || '],\"parameters\":\"force\"}') AS cache_key FROM events GROUP BY 1")
def graph_cache_keys(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("ids")).withColumn("parameters", F.lit("force"))
    return rows.select("user_id", jobs.cache_key("ids", "parameters").alias("cache_key"))
