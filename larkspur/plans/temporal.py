"""Point-in-time reads, supersession and contradiction resolution over events as versions of (user_id, event_type)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import temporal as t
from larkspur.plans.registry import query, table

AT, FROM, TO = "2024-01-05 00:00:00", "2024-01-03 00:00:00", "2024-01-08 00:00:00"
E = """e0 AS (SELECT event_id, user_id, event_type, value, ts AS created_at, ts AS valid_at FROM events),
e AS (SELECT *, lead(valid_at) OVER (PARTITION BY user_id, event_type ORDER BY valid_at, event_id) AS invalid_at FROM e0)"""


def _at(s):
    return F.lit(s).cast("timestamp")


def _raw(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"))


def _versions(spark, sf):
    return t.superseded(_raw(spark, sf), ["user_id", "event_type"], ["event_id"])


@query(f"WITH {E} SELECT event_id, user_id, event_type FROM e WHERE valid_at <= TIMESTAMP '{AT}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AT}')")
def pit_snapshot(spark, sf):
    return t.snapshot(_versions(spark, sf), _at(AT)).select("event_id", "user_id", "event_type")


@query(f"WITH {E} SELECT event_id FROM e WHERE event_type = 'click' AND created_at <= TIMESTAMP '{AT}' AND valid_at <= TIMESTAMP '{AT}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AT}')")
def tri_temporal_search(spark, sf):
    return _versions(spark, sf).where("event_type = 'click'").where(t.known(_at(AT))).select("event_id")


@query(f"WITH {E} SELECT event_id, user_id FROM e WHERE valid_at BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{TO}')")
def temporal_range(spark, sf):
    return t.started_within(_versions(spark, sf), _at(FROM), _at(TO)).select("event_id", "user_id")


@query(f"WITH {E} SELECT event_id, event_type, epoch_us(valid_at) AS start_us, epoch_us(invalid_at) AS end_us FROM e WHERE user_id = 7")
def entity_history(spark, sf):
    return t.history(_versions(spark, sf), "user_id", 7).select("event_id", "event_type", F.unix_micros("valid_at").alias("start_us"), F.unix_micros("invalid_at").alias("end_us"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'missing valid_at' WHEN event_id % 5 = 0 THEN 'valid after created' ELSE '' END AS problems FROM events""")
def temporal_validate(spark, sf):
    """Rows damaged on purpose: each seventh lost its start, each other fifth begins after it was recorded."""
    rows = _raw(spark, sf).withColumn("valid_at", F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, F.col("valid_at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("valid_at")))
    return rows.select("event_id", F.array_join(t.problems(), ", ").alias("problems"))


@query(f"WITH {E} SELECT event_id, epoch_us(valid_at) AS start_us, epoch_us(invalid_at) AS end_us FROM e")
def supersede_scd2(spark, sf):
    return _versions(spark, sf).select("event_id", F.unix_micros("valid_at").alias("start_us"), F.unix_micros("invalid_at").alias("end_us"))


@query(f"WITH {E} SELECT event_id, epoch_us(CASE WHEN user_id = 7 AND invalid_at IS NULL THEN TIMESTAMP '{TO}' ELSE invalid_at END) AS end_us FROM e")
def invalidate_open(spark, sf):
    rows = _versions(spark, sf)
    return t.invalidated(rows, F.col("user_id") == 7, _at(TO)).select("event_id", F.unix_micros("invalid_at").alias("end_us"))


@query("SELECT event_id, epoch_us(ts) AS created_us, epoch_us(ts) AS valid_us, NULL::BIGINT AS end_us FROM events")
def temporal_defaults(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"), F.lit("9999-12-31 23:59:59").alias("invalid_at"))
    return t.with_defaults(rows, _at(AT)).select("event_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("valid_at").alias("valid_us"), F.unix_micros("invalid_at").alias("end_us"))


@query("SELECT event_id, epoch_us(CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-05' ELSE ts END) AS valid_us FROM events")
def backfill_bitemporal(spark, sf):
    null = F.lit(None).cast("timestamp")
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("ts")).cast("timestamp").alias("timestamp"), null.alias("created_at"), null.alias("valid_at"), null.alias("invalid_at"))
    return t.backfilled(rows, "timestamp", _at(AT)).select("event_id", F.unix_micros("valid_at").alias("valid_us"))


def _spans(spark, sf):
    """Events as rows that hold for as many hours as their value says."""
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("valid_at"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.floor("value") * 3_600_000_000).cast("long")).alias("invalid_at"))


S = "s AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS a, epoch_us(ts) + floor(value)::BIGINT * 3600000000 AS z FROM events)"
PAIRS = f"{S}, p AS (SELECT x.event_id AS one, y.event_id AS two, x.a AS a1, x.z AS z1, y.a AS a2, y.z AS z2 FROM s x JOIN s y USING (user_id, event_type) WHERE x.event_id <> y.event_id AND x.a < y.z AND y.a < x.z)"


@query(f"WITH {PAIRS} SELECT one, two FROM p")
def overlap_join(spark, sf):
    rows = _spans(spark, sf)
    return t.overlapping(rows, rows, ["user_id", "event_type"], "event_id", "event_id").select("one", "two")


def _pairs(spark, sf):
    rows = _spans(spark, sf)
    found = t.overlapping(rows, rows, ["user_id", "event_type"], "event_id", "event_id").where("one > two")
    return found.select(F.col("one").alias("new_id"), F.col("two").alias("old_id"), F.col("s1").alias("new_created_at"), F.col("s1").alias("new_valid_at"), F.col("e1").alias("new_invalid_at"), F.col("s2").alias("old_created_at"), F.col("s2").alias("old_valid_at"), F.col("e2").alias("old_invalid_at"))


def _us(df, *cols):
    return df.select("new_id", "old_id", "action", *(F.unix_micros(c).alias(c) for c in cols))


@query(f"WITH {PAIRS} SELECT one AS new_id, two AS old_id, CASE WHEN a1 >= a2 THEN 'invalidate_old' ELSE 'invalidate_new' END AS action, CASE WHEN a1 >= a2 THEN a1 ELSE z2 END AS result_old_end, CASE WHEN a1 >= a2 THEN z1 ELSE a2 END AS result_new_end FROM p WHERE one > two")
def resolve_newest(spark, sf):
    return _us(t.resolved(_pairs(spark, sf), "newest_wins"), "result_old_end", "result_new_end")


@query(f"WITH {PAIRS} SELECT one AS new_id, two AS old_id, 'merge' AS action, least(a1, a2) AS merged_valid_at, greatest(z1, z2) AS merged_invalid_at FROM p WHERE one > two")
def resolve_merge(spark, sf):
    return _us(t.resolved(_pairs(spark, sf), "merge"), "merged_valid_at", "merged_invalid_at")


@query(f"""WITH {PAIRS}, o AS (SELECT one, two, CASE WHEN a1 >= a2 THEN a2 ELSE a1 END AS fa, CASE WHEN a1 >= a2 THEN z2 ELSE z1 END AS fz, CASE WHEN a1 >= a2 THEN a1 ELSE a2 END AS sa, CASE WHEN a1 >= a2 THEN z1 ELSE z2 END AS sz FROM p WHERE one > two)
SELECT one AS new_id, two AS old_id, CASE WHEN sz < fz THEN 'split_in_three' ELSE 'split_in_two' END AS action, fa AS first_start, sa AS first_end, sa AS second_start, sz AS second_end, CASE WHEN sz < fz THEN sz END AS third_start, CASE WHEN sz < fz THEN fz END AS third_end FROM o""")
def resolve_split(spark, sf):
    return _us(t.resolved(_pairs(spark, sf), "split_timeline"), "first_start", "first_end", "second_start", "second_end", "third_start", "third_end")


@query(f"WITH {PAIRS} SELECT CASE WHEN a1 >= a2 THEN 'invalidate_old' ELSE 'invalidate_new' END AS action, count(*) AS total, count(*) AS resolved FROM p WHERE one > two GROUP BY 1")
def contradiction_summary(spark, sf):
    log = t.resolution_log(t.resolved(_pairs(spark, sf), "newest_wins"), "newest_wins", "overlap")
    return t.log_summary(log)


@query(f"WITH {E} SELECT event_id, event_type FROM e WHERE user_id = 3 AND event_type = 'view' AND valid_at <= TIMESTAMP '{AT}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AT}')")
def temporal_edges(spark, sf):
    """Edges user -> type; one without a start never holds."""
    rows = _versions(spark, sf).where("user_id = 3 AND event_type = 'view'")
    return rows.where(t.valid(_at(AT), missing_start=False)).select("event_id", "event_type")
