"""Proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash and ranked within their source; row i of a source with n rows gets the fractional rank
(2 i - 1) / 2 n. Sorted by it, every stretch of the order holds the sources in proportion, so equal cuts of the order make
shards that match the mixture, with sizes at most one row apart.

No window spans a source or the table: ranks come from counts of hash buckets (prefix sums over a bounded number of
buckets) plus a rank within a bucket, so a source that holds a third of all rows spreads over as many tasks as others.

Defined cases: a null source is a source of its own; null texts have no bytes; rows with a null id stay; repeated rows
tie, and ties leave equal rows in any order, which changes nothing; an empty table gives an empty result; all columns
stay, but one named `shard` or `slot` gives way to the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import prefix_sums, small, written

#: Rows that one bucket should hold, and the most buckets of an order.
_BUCKET = 1000
_BUCKETS = 1 << 20
#: Rows (32 bytes each) up to which a table of bucket counts is broadcast.
_COUNTS = 1 << 20


def _ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with `rank__` (from 1) within `by`, in the order of (bucket__, order)."""
    counts = written(rows.groupBy(*by, "bucket__").agg(F.count("*").alias("n__")), "buckets")
    before = prefix_sums(counts, "bucket__", "n__", by).select(*(F.col(c).alias(f"of_{c}") for c in (*by, "bucket__")), F.col("before").alias("before__"))
    same = F.lit(True)
    for c in (*by, "bucket__"):
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    within = Window.partitionBy(*by, "bucket__").orderBy(*order)
    return rows.join(small(before, _COUNTS), same).withColumn("rank__", F.col("before__") + F.row_number().over(within)).select(*rows.columns, "rank__")


def interleaved(docs: DataFrame, shards: int = 8, seed: int = 0, source_col: str = "source", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns with `shard` and `slot` (gapless from 0 in each shard)."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    n = docs.count()
    buckets = max(1, min(_BUCKETS, -(-n // _BUCKET)))
    key = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))
    part = F.conv(F.substring("shuffle__", 1, 7), 16, 10).cast("long")
    rows = docs.withColumns({"shuffle__": key, "source__": F.col(source_col).cast("string")} | {f"key{i}__": F.col(k) for i, k in enumerate(keys)})
    rows = rows.withColumn("bucket__", F.floor(part * buckets / (1 << 28)).cast("int"))
    totals = written(rows.groupBy("source__").agg(F.count("*").alias("total__")), "sources")
    ties = [F.col("shuffle__"), *(F.col(f"key{i}__") for i in range(len(keys)))]
    ranked = _ranked(rows, ["source__"], ties)
    ranked = ranked.join(small(totals.withColumnRenamed("source__", "of__"), _COUNTS), F.col("source__").eqNullSafe(F.col("of__")))
    fraction = (2 * F.col("rank__") - 1) / (2 * F.col("total__"))
    placed = ranked.withColumn("fraction__", fraction).withColumn("bucket__", F.least(F.floor(F.col("fraction__") * buckets), F.lit(buckets - 1)).cast("int")).withColumn("all__", F.lit(0))
    placed = written(placed.drop("rank__", "of__", "total__"), "fractions")
    order = _ranked(placed, ["all__"], [F.col("fraction__"), F.col("source__"), *ties])
    at = F.col("rank__") - 1
    shard = F.floor(at * shards / F.lit(max(1, n))).cast("int")
    return order.withColumn("shard", shard).withColumn("slot", at - F.ceil(F.col("shard") * F.lit(n) / shards)).select(*kept, "shard", "slot")
