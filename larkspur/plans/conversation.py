"""Conversations, compaction and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import conversation as c
from larkspur.plans.registry import query, table


@query("SELECT conv_id, turn AS src, nxt AS dst FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL")
def next_edges(spark, sf):
    return c.next_edges(table(spark, sf, "conversations"), "conv_id", "turn")


@query("WITH n AS (SELECT *, lead(role) OVER w AS r2, lead(turn) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CASE WHEN r2 = 'assistant' THEN t2 END AS answer_turn FROM n WHERE role = 'user'")
def turn_pairs(spark, sf):
    return c.turn_pairs(table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("SELECT conv_id, md5(string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS hash, count(*) AS turns FROM conversations GROUP BY 1")
def transcript(spark, sf):
    t = c.transcripts(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return t.select("conv_id", F.md5("transcript").alias("hash"), "turns")


@query("SELECT conv_id, count(*) AS message_count, length(string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) // 4 AS original_tokens FROM conversations GROUP BY 1")
def compaction_stats(spark, sf):
    return c.compactions(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "message_count", "original_tokens")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 ORDER BY turn DESC LIMIT 3 OFFSET 1")
def history_page(spark, sf):
    return c.history(table(spark, sf, "conversations"), "conv_id", 3, "turn", True, 3, 1).select("conv_id", "turn", "role")


@query("SELECT conv_id || '-0' AS message, conv_id AS conversation, 'user' AS type, md5(text) AS hash FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id || '-1', conv_id, 'agent', md5('reply') FROM conversations WHERE turn = 0")
def store_exchange(spark, sf):
    rows = table(spark, sf, "conversations").where("turn = 0").select("conv_id", "text", F.lit("reply").alias("reply"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    return c.exchanges(rows, "conv_id", "text", "reply", "at").select("message", "conversation", "type", F.md5("content").alias("hash"))


@query("SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(DISTINCT event_type) AS entity_count, count(*) AS link_count FROM events GROUP BY 1")
def episodes(spark, sf):
    e = c.episodes(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "event_type", "ts")
    return e.select("user_id", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "entity_count", "link_count")


@query("SELECT user_id FROM (SELECT user_id, min(ts) AS a, CASE WHEN user_id % 4 = 0 THEN NULL ELSE max(ts) END AS z FROM events GROUP BY 1) WHERE a >= TIMESTAMP '2024-01-01 06:00:00' AND (z <= TIMESTAMP '2024-01-25' OR z IS NULL)")
def episode_search(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time")).withColumn("end_time", F.when(F.col("user_id") % 4 != 0, F.col("end_time")))
    at = lambda s: F.lit(s).cast("timestamp")
    return c.episodes_found(e, start=at("2024-01-01 06:00:00"), end=at("2024-01-25")).select("user_id")
