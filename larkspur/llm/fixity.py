"""Merkle fixity audit of archived records.

Records are hashed; ordered ranges of offsets within a volume are leaves; nodes above hash the digests of up to `FANOUT`
children in order, first within a volume, then over volumes, up to one root. Two replicas with equal roots are equal.
Otherwise the audit descends from the root only into nodes whose digests differ, down to ranges, and compares records
there. A range spans a fixed number of bytes and every record counts its header, so no node gathers an unbounded group.

Defined cases: null fields hash apart from empty ones; records without a volume or offset are left out; records that
repeat an offset are compared as a set; two empty replicas are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import written

RANGE, FANOUT, HEADER = 1 << 16, 16, 64


def record_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each led by its length, or by `-` where it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    return F.sha2(F.concat_ws("|", *parts), 256)


def laid_out(records: DataFrame, volume: Column, order: list[str], fields: list[str]) -> DataFrame:
    """records' order columns with `volume`, `offset` (bytes before it in the volume), `size` and `digest`."""
    size = F.lit(HEADER) + sum((F.coalesce(F.octet_length(f), F.lit(0)) for f in fields), F.lit(0))
    rows = records.select(*order, volume.alias("volume"), size.cast("long").alias("size"), record_digest(*(F.col(f).cast("string") for f in fields)).alias("digest"))
    before = Window.partitionBy("volume").orderBy(*order, "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.where("volume is not null").withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def _folded(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    children = F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col(at).cast("string"), 19, "0"), "digest")))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(children, ","), 256).alias("digest"))


def tree(records: DataFrame, depth: int, height: int) -> list[DataFrame]:
    """Levels from ranges to the root: `depth` within volumes and `height` above them; nodes are (volume, range)."""
    leaf = records.select("volume", F.floor(F.col("offset") / RANGE).alias("range"), "offset", "digest")
    levels = [written(_folded(leaf, ["volume", "range"], "offset"), "leaves")]
    for _ in range(depth):
        up = levels[-1].withColumn("child", F.col("range")).withColumn("range", F.floor(F.col("range") / FANOUT))
        levels.append(written(_folded(up, ["volume", "range"], "child"), "nodes"))
    for _ in range(height):
        up = levels[-1].withColumn("child", F.col("volume")).withColumn("volume", F.floor(F.col("volume") / FANOUT))
        levels.append(written(_folded(up, ["volume", "range"], "child"), "nodes"))
    return levels


def _steps(top: int | None) -> int:
    n = 0
    while top and top > 0:
        top, n = top // FANOUT, n + 1
    return n


def _different(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    other = b.withColumnRenamed("digest", "digest_b")
    return a.join(other, keys, "full").where(~F.col("digest").eqNullSafe(F.col("digest_b")))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(volume, offset, status) of records that are `changed`, `missing` in the second replica, or `extra` there.

    Both hold volume, offset (whole numbers from 0) and digest.
    """
    sides = [written(x.where("volume is not null and offset is not null").select(F.col("volume").cast("long"), F.col("offset").cast("long"), "digest"), "replica") for x in (first, second)]
    tops = sides[0].unionByName(sides[1]).agg(F.max(F.floor(F.col("offset") / RANGE)).alias("range"), F.max("volume").alias("volume")).first()
    depth, height = _steps(tops["range"]), _steps(tops["volume"])
    trees = [tree(x, depth, height) for x in sides]
    keys = ["volume", "range"]
    bad = written(_different(trees[0][-1], trees[1][-1], keys).select(*keys), "differ")
    for level in range(depth + height - 1, -1, -1):
        if bad.isEmpty():
            break
        up = {"volume": F.floor(F.col("volume") / FANOUT), "range": F.col("range")} if level >= depth else {"volume": F.col("volume"), "range": F.floor(F.col("range") / FANOUT)}
        named = bad.select(F.col("volume").alias("up_volume"), F.col("range").alias("up_range"))
        below = [t[level].join(named, (up["volume"] == F.col("up_volume")) & (up["range"] == F.col("up_range")), "left_semi") for t in trees]
        bad = written(_different(*below, keys).select(*keys), "differ")
    spots = [x.withColumn("range", F.floor(F.col("offset") / RANGE)).join(bad, keys, "left_semi") for x in sides]
    sets = [x.groupBy("volume", "offset").agg(F.array_join(F.array_sort(F.collect_list("digest")), ",").alias("digest")) for x in spots]
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return _different(*sets, ["volume", "offset"]).select("volume", "offset", status.alias("status"))
