"""Structured Streaming: continuous attribution, windowed counts with a watermark, and rate-limited admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import BooleanType, StructField, StructType

from larkspur.operators import risk

OBSERVATIONS = "observation_id long, session string, technique string, ts timestamp"


def observations(spark: SparkSession, path: str, per_trigger: int = 10) -> DataFrame:
    """New files of JSON lines as a stream; the checkpoint of the query that reads it replaces a `processed` flag."""
    return spark.readStream.schema(OBSERVATIONS).option("maxFilesPerTrigger", per_trigger).json(path)


def attribute_continuously(stream: DataFrame, profiles: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each batch's sessions with the actor that explains them best, appended as Parquet; exactly once by batch folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        risk.attributed(batch, profiles, "session").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("events")).select("window.start", "window.end", group, "events")


def admitted(times: list[float], rate: float, burst: int, recent: list[float], apart: float = 0.0) -> tuple[list[bool], list[float]]:
    """Greedy admission: at most `burst` in any burst / rate seconds, each at least `apart` seconds after the last admitted."""
    out, window = [], burst / rate
    for t in times:
        recent = [r for r in recent if r > t - window]
        ok = len(recent) < burst and (not recent or t - recent[-1] >= apart)
        out.append(ok)
        if ok:
            recent.append(t)
    return out, recent


def rate_limited(rows: DataFrame, key: str, time: str, tie: str, rate: float, burst: int) -> DataFrame:
    """Batch form: rows with `admitted`, decided in order of time within each key, calls 1 / rate seconds apart.

    The fold is sequential by nature: a partition is sorted and streamed, and only the times admitted within the window
    are carried from one batch of a key to the next.
    """
    schema = StructType([*rows.schema.fields, StructField("admitted", BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = None, []
        for batch in batches:
            ok: list[bool] = []
            for _, part in batch.groupby((batch[key].ne(batch[key].shift()) & (batch[key].notna() | batch[key].shift().notna())).cumsum(), sort=True):
                of = part[key].iloc[0]
                of = None if pd.isna(of) else of
                if (of,) != last:
                    last, recent = (of,), []
                got, recent = admitted([t.timestamp() for t in part[time]], rate, burst, recent, 1 / rate)
                ok += got
            yield batch.assign(admitted=ok)

    return rows.repartition(key).sortWithinPartitions(key, time, tie).mapInPandas(run, schema)


def _stateful(spark: SparkSession) -> None:
    """State with timers and lifetimes lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rate_limited_stream(stream: DataFrame, key: str, time: str, rate: float, burst: int, late: str = "0 seconds") -> DataFrame:
    """Streaming form, by the same rule: (key, time, admitted) of each call, in order of time within a micro-batch.

    State a key is the times admitted within the window. A timer on the watermark drops it once burst / rate seconds have
    passed since the last of them, so keys that fall silent leave the state.
    """
    window, of = burst / rate, key

    class Limiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.recent = handle.getValueState("recent", "times array<double>")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            before = list(self.recent.get()[0]) if self.recent.exists() else []
            times = sorted(t.timestamp() for b in rows for t in b[time])
            ok, recent = admitted(times, rate, burst, before, 1 / rate)
            for at in before[-1:]:
                self.handle.deleteTimer(_due(at))
            if recent:
                self.recent.update((recent,))
                self.handle.registerTimer(_due(recent[-1]))
            yield pd.DataFrame({of: [key[0]] * len(times), "time": pd.to_datetime(times, unit="s"), "admitted": ok})

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.recent.clear()
            return iter([])

        def close(self) -> None:
            pass

    def _due(last: float) -> int:
        return int((last + window) * 1000) + 1

    _stateful(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    grouped = stream.withWatermark(time, late).groupBy(key)
    return grouped.transformWithStateInPandas(Limiter(), f"`{key}` {kind}, time timestamp, admitted boolean", "Append", "EventTime")


def cached_stream(requests: DataFrame, key: str, render, lifetime_ms: int, schema: str = "rendered string") -> DataFrame:
    """(key, rendered, hit) of each request (key, ...): what `render(key)` gave within the lifetime, else rendered anew.

    The entry's time to live is the state store's own, counted from when it was rendered; an expired entry leaves the state.
    """
    name, of = schema.split()[0], key

    class Cache(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.entry = handle.getValueState("entry", schema, lifetime_ms)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            n, hit = sum(len(b) for b in rows), self.entry.exists()
            value = self.entry.get()[0] if hit else render(key[0])
            if not hit:
                self.entry.update((value,))
            yield pd.DataFrame({of: [key[0]] * n, name: [value] * n, "hit": [hit] + [True] * (n - 1)})

        def close(self) -> None:
            pass

    _stateful(requests.sparkSession)
    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).transformWithStateInPandas(Cache(), f"`{key}` {kind}, {schema}, hit boolean", "Update", "ProcessingTime")


def cache_replay(requests: DataFrame, key: str, time: str, tie: str, lifetime: str) -> DataFrame:
    """requests with `hit`: whether an entry rendered less than a lifetime before was there; the same rule on recorded times.

    Requests at least a lifetime after the one before always miss, so only what lies between two such gaps is walked, in order.
    """
    w = Window.partitionBy(key).orderBy(time, tie)
    span = F.expr(f"INTERVAL '{lifetime}'")
    fresh = F.coalesce(F.col(time) >= F.lag(time).over(w) + span, F.lit(True))
    parts = requests.withColumn("part__", F.sum(fresh.cast("int")).over(w))
    schema = StructType([*parts.schema.fields, StructField("hit", BooleanType())])
    seconds = pd.Timedelta(lifetime)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, since = None, None
        for batch in batches:
            hits = []
            for k, part, t in zip(batch[key], batch["part__"], batch[time]):
                if (k, part) != last or t >= since + seconds:
                    last, since = (k, part), t
                    hits.append(False)
                else:
                    hits.append(True)
            yield batch.assign(hit=hits)

    return parts.repartition(key, "part__").sortWithinPartitions(key, "part__", time, tie).mapInPandas(run, schema).drop("part__")


def cache_key(ids: str, parameters: str) -> Column:
    """A digest of an array column's sorted ids and a parameter column: equal graphs share an entry."""
    return F.sha2(F.to_json(F.struct(F.array_sort(F.col(ids)).alias("ids"), F.col(parameters).alias("parameters"))), 256)


def limiter_stats(rows: DataFrame, key: str, time: str, at: Column, rate: float, burst: int) -> DataFrame:
    """(key, current_calls, available_capacity) of limiters at a time, from rows with `admitted`: calls of the last
    burst / rate seconds, and how many more would be let through by count. Keys without such calls have it all."""
    since = F.unix_micros(at) - int(burst / rate * 1_000_000)
    live = F.col("admitted") & (F.unix_micros(time) > since) & (F.unix_micros(time) <= F.unix_micros(at))
    return rows.groupBy(key).agg(F.count_if(live).alias("current_calls"), (F.lit(burst).cast("long") - F.count_if(live)).alias("available_capacity"))
