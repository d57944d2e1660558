"""Bi-temporal tables: created_at is when a row was recorded, [valid_at, invalid_at) when it held.

A null invalid_at is open. Comparisons are of timestamps, never of their texts; nulls are spelled out in each predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR_FUTURE = "9999-12-31"


def with_defaults(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Fill created_at and valid_at, and turn a far-future end into an open one."""
    now = F.current_timestamp() if now is None else now
    have = set(rows.columns)
    col = lambda c: F.col(c).cast("timestamp") if c in have else F.lit(None).cast("timestamp")
    created = F.coalesce(col("created_at"), now)
    end = F.when(col("invalid_at") < F.lit(FAR_FUTURE).cast("timestamp"), col("invalid_at"))
    return rows.withColumns({"created_at": created, "valid_at": F.coalesce(col("valid_at"), created), "invalid_at": end})


def iso8601(t: Column) -> Column:
    """A time as text, in UTC to the millisecond, whatever the session's zone."""
    us = F.unix_micros(t)
    whole = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(us).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(F.floor(us / 1000), F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))


def shifted(t: Column, amount: int, unit: str) -> Column:
    """A time moved by whole units; months and years keep the day where the month has it."""
    return t + F.expr(f"make_interval({', '.join(str(amount) if u == unit.rstrip('s') else '0' for u in ('year', 'month', 'week', 'day', 'hour', 'minute', 'second'))})")


def decorated(edges: DataFrame, valid_from: Column, valid_until: Column, now: Column | None = None, source: Column | None = None) -> DataFrame:
    """edges with created_at, valid_at, invalid_at, confidence (1.0 where they have none) and, given a source row's struct (id, key),
    source_id and source_key. Times are ISO texts: a start that is none counts from now, an end that is none stays open."""
    now, have = F.current_timestamp() if now is None else now, set(edges.columns)
    iso = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(c))
    new = {"created_at": now, "valid_at": F.coalesce(iso(valid_from), now), "invalid_at": iso(valid_until), "confidence": F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in have else F.lit(1.0)}
    return edges.withColumns(new if source is None else {**new, "source_id": source["id"], "source_key": source["key"]})


def backfilled(rows: DataFrame, time_col: str, now: Column) -> DataFrame:
    """Old rows made bi-temporal: valid from their own time, else from when they were recorded, else from now."""
    return rows.withColumns({"valid_at": F.coalesce("valid_at", time_col, "created_at", now), "created_at": F.coalesce("created_at", time_col, now), "invalid_at": F.col("invalid_at")})


def valid(t: Column, missing_start: bool = True) -> Column:
    """Holds at t. A row without a start holds from ever, or never with missing_start=False (edges)."""
    start = F.coalesce(F.col("valid_at") <= t, F.lit(missing_start))
    return start & F.coalesce(F.col("invalid_at") > t, F.lit(True))


def known(t: Column) -> Column:
    """Holds at t and was recorded by then."""
    return F.coalesce(F.col("created_at") <= t, F.lit(True)) & valid(t)


def snapshot(rows: DataFrame, t: Column, **equal) -> DataFrame:
    for c, v in equal.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return rows.where(valid(t))


def started_within(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows that began in [start, end] and still held after end."""
    return rows.where(F.col("valid_at").between(start, end) & F.coalesce(F.col("invalid_at") > end, F.lit(True)))


def history(rows: DataFrame, key: str, value, include_invalidated: bool = True) -> DataFrame:
    rows = rows.where(F.col(key) == value)
    return (rows if include_invalidated else rows.where("invalid_at IS NULL")).orderBy(F.desc("valid_at"))


def invalidated(rows: DataFrame, which: Column, t: Column, reason: str | None = None, overwrite: bool = False) -> DataFrame:
    """End the rows that `which` names; ended ones keep their end unless overwrite."""
    hit = which if overwrite else which & F.col("invalid_at").isNull()
    rows = rows.withColumn("hit__", F.coalesce(hit, F.lit(False))).withColumn("invalid_at", F.when(F.col("hit__"), t).otherwise(F.col("invalid_at")))
    if reason is not None:
        rows = rows.withColumn("invalidation_reason", F.when(F.col("hit__"), reason).otherwise(F.col("invalidation_reason") if "invalidation_reason" in rows.columns else F.lit(None)))
    return rows.drop("hit__")


def problems() -> Column:
    """Names of what is wrong with a row's times."""
    return F.array_compact(F.array(
        F.when(F.col("created_at").isNull(), "missing created_at"),
        F.when(F.col("valid_at").isNull(), "missing valid_at"),
        F.when(F.col("valid_at") > F.col("created_at"), "valid after created"),
        F.when(F.col("invalid_at") <= F.col("valid_at"), "ends before it begins"),
    ))


def superseded(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Each version ends where the next of its key begins, unless it ended before."""
    w = Window.partitionBy(*keys).orderBy("valid_at", *(order or []))
    return rows.withColumn("invalid_at", F.least("invalid_at", F.lead("valid_at").over(w)))


#: The narrowest buckets, in microseconds; each level's are four times as wide as the last's. The level of open intervals.
_NARROW, _OPEN = 1_000_000, 99


def _leveled(rows: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """rows (lo, hi in microseconds, null if open) with the level whose buckets are at least as wide as the interval; with
    levels, one row for each bucket of this and each higher level that the interval touches, and its first bucket there."""
    width = F.greatest((F.col("hi") - F.col("lo")) / _NARROW, F.lit(1.0))
    own = F.when(F.col("lo").isNull() | F.col("hi").isNull(), _OPEN).otherwise(F.ceil(F.log2(width) / 2 - 1e-9)).cast("int")
    if levels is None:
        return rows.select(own.alias("level"))
    at = rows.withColumn("own", own).withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("own"))))
    number = lambda c: F.when(F.col("level") == _OPEN, F.lit(0)).otherwise(F.floor(F.col(c) / (_NARROW * F.pow(F.lit(4.0), "level")))).cast("long")
    first = at.withColumn("first", number("lo"))
    return first.withColumn("bucket", F.explode(F.sequence("first", number("hi")))).withColumn("own", F.col("own") == F.col("level"))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], key_a: str, key_b: str, include_invalidated: bool = True) -> DataFrame:
    """(key_a, key_b) of rows with equal keys whose validity overlaps, a missing end being open.

    Intervals fall into time buckets about as wide as they are long, so a key with most rows is spread over its buckets: each
    touches one or two of its own level and of each coarser one, a pair meets on the coarser of its two levels and counts in
    its first common bucket. Open intervals share a level that has one bucket a key.
    """
    side = lambda df, k, n: df.select(*keys, F.col(k).alias(("one", "two")[n - 1]), F.col("valid_at").alias(f"s{n}"), F.col("invalid_at").alias(f"e{n}"), F.unix_micros(F.least("valid_at", "invalid_at")).alias("l0"), F.unix_micros(F.greatest("valid_at", "invalid_at")).alias("h0"))
    whole = lambda df, n: df.withColumns({"lo": F.when(F.col(f"s{n}").isNotNull() & F.col(f"e{n}").isNotNull(), F.col("l0")), "hi": F.when(F.col(f"s{n}").isNotNull() & F.col(f"e{n}").isNotNull(), F.col("h0"))}).drop("l0", "h0")
    x = whole(side(a, key_a, 1), 1)
    y = whole(side(b if include_invalidated else b.where("invalid_at IS NULL"), key_b, 2), 2)
    levels = sorted(r["level"] for r in _leveled(x).unionByName(_leveled(y)).distinct().collect())  # a few dozen at most
    met = ["level", "bucket", *keys]
    one = _leveled(x, levels).select(*met, "one", "s1", "e1", F.col("own").alias("own1"), F.col("first").alias("first1"))
    two = _leveled(y, levels).select(*met, "two", "s2", "e2", F.col("own").alias("own2"), F.col("first").alias("first2"))
    meets = F.coalesce(F.col("s1") < F.col("e2"), F.lit(True)) & F.coalesce(F.col("s2") < F.col("e1"), F.lit(True))
    once = (F.col("own1") | F.col("own2")) & (F.col("bucket") == F.greatest("first1", "first2"))
    return one.join(two, met).where(F.col("one") != F.col("two")).where(once & meets).select(*keys, "one", "s1", "e1", "two", "s2", "e2")


def resolved(pairs: DataFrame, strategy: str) -> DataFrame:
    """What becomes of contradicting rows (new_* and old_* columns created_at, valid_at, invalid_at).

    newest_wins: the row recorded later stays, the other ends where it begins. merge: one row over both validities, open
    if either is. split_timeline: the earlier row ends where the later begins; after a later row that ends inside it, the
    earlier one holds again. Equal times keep the new row.
    """
    new, old = (lambda c: F.col(f"new_{c}")), (lambda c: F.col(f"old_{c}"))
    if strategy == "newest_wins":
        wins = F.coalesce(new("created_at") >= old("created_at"), F.lit(True))
        return pairs.withColumns({
            "action": F.when(wins, "invalidate_old").otherwise("invalidate_new"),
            "result_old_end": F.when(wins, new("valid_at")).otherwise(old("invalid_at")),
            "result_new_end": F.when(wins, new("invalid_at")).otherwise(old("valid_at")),
        })
    if strategy == "merge":
        return pairs.withColumns({
            "action": F.lit("merge"),
            "merged_valid_at": F.least(new("valid_at"), old("valid_at")),
            "merged_invalid_at": F.when(new("invalid_at").isNotNull() & old("invalid_at").isNotNull(), F.greatest(new("invalid_at"), old("invalid_at"))),
        })
    if strategy == "split_timeline":
        later = new("valid_at") >= old("valid_at")
        first, second = (lambda c: F.when(later, old(c)).otherwise(new(c))), (lambda c: F.when(later, new(c)).otherwise(old(c)))
        inside = second("invalid_at").isNotNull() & F.coalesce(second("invalid_at") < first("invalid_at"), F.lit(True))
        return pairs.withColumns({
            "action": F.when(inside, "split_in_three").otherwise("split_in_two"),
            "first_start": first("valid_at"),
            "first_end": second("valid_at"),
            "second_start": second("valid_at"),
            "second_end": second("invalid_at"),
            "third_start": F.when(inside, second("invalid_at")),
            "third_end": F.when(inside, first("invalid_at")),
        })
    raise ValueError(f"unknown strategy {strategy!r}")


def resolution_log(resolutions: DataFrame, strategy: str, context: str) -> DataFrame:
    """Log rows with both sides and the resolution as structs."""
    side = lambda p: F.struct(*(F.col(c).alias(c.removeprefix(p)) for c in resolutions.columns if c.startswith(p)))
    resolution = F.struct(F.col("action"), F.lit(strategy).alias("strategy"), F.lit(True).alias("success"))
    return resolutions.select(side("new_").alias("new_edge"), side("old_").alias("existing_edge"), resolution.alias("resolution"), F.lit(context).alias("context"), F.lit("resolved").alias("status"))


def log_filtered(log: DataFrame, entity: str | None = None, action: str | None = None, status: str | None = None) -> DataFrame:
    if entity is not None:
        ends = [F.col(f"{s}.{c}") == entity for s in ("new_edge", "existing_edge") for c in ("src", "dst")]
        log = log.where(ends[0] | ends[1] | ends[2] | ends[3])
    if action is not None:
        log = log.where(F.col("resolution.action") == action)
    return log if status is None else log.where(F.col("status") == status)


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy(F.col("resolution.action").alias("action")).agg(F.count("*").alias("total"), F.count_if(F.col("resolution.success")).alias("resolved"))
