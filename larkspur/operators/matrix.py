"""Comparing many vectors with many: rows are dealt into blocks, blocks into tiles, and pairs of tiles are multiplied.

Within a group every block has about `ROWS` vectors whatever the group's size, and a task multiplies two tiles of `TILE`
blocks, a strip of `CELLS` products at a time, so a group with most rows becomes many tasks of equal size; each keeps at most the `most` best of a row before the
shuffle. The number of products is that of all pairs within a group: give it groups that are as fine as the question allows, or
ask with a stated set. Null vectors take no part; vectors of another length are of another group; a zero vector has cosine 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, blocks of a tile, and products that a task holds at a time.
ROWS, TILE, CELLS = 1024, 8, 1 << 20
_GROUP = ["group__", "dims__"]


def _keyed(rows: DataFrame, key: str, column: str, group: Column | None) -> DataFrame:
    v = F.col(column).cast("array<double>")
    return rows.where(F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull())).select(F.lit(0).alias("group__") if group is None else group.alias("group__"), F.size(v).alias("dims__"), F.col(key).alias("key"), v.alias("v")).where("group__ IS NOT NULL AND dims__ > 0")


def _tiled(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with the tile of each; sizes has the tiles of each group."""
    return rows.join(sizes, _GROUP).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")).drop("tiles")


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_GROUP).agg(F.ceil(F.count("*") / (ROWS * TILE)).cast("int").alias("tiles"))


def best_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, column: str, floor: float, most: int | None, group: Column | None = None, right_group: Column | None = None, strict: bool = False, others: bool = True) -> DataFrame:
    """(left_key, right_key, similarity): for each left row up to `most` right rows of its group at a cosine of at least `floor`
    (above it, if strict), the highest first, ties to the smaller key; others=False lets a row match its own key."""
    a, b = _keyed(left, left_key, column, group), _keyed(right, right_key, column, group if right_group is None else right_group)
    size_a, size_b = _sizes(a), _sizes(b)
    one = _tiled(a, size_a).join(size_b.withColumnRenamed("tiles", "n"), _GROUP).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    two = _tiled(b, size_b).join(size_a.withColumnRenamed("tiles", "n"), _GROUP).withColumn("of", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    one, two = one.select(*_GROUP, F.col("tile").alias("i"), F.col("other").alias("j"), "key", "v"), two.select(*_GROUP, F.col("of").alias("i"), F.col("tile").alias("j"), "key", "v")
    kinds = [dict(x.dtypes)["key"] for x in (a, b)]

    def matrix(t: pa.Table) -> np.ndarray:
        v = t.column("v").combine_chunks()
        return v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[-1].as_py()].reshape(len(v), -1)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        keys_a, keys_b = (t.column("key").combine_chunks() for t in (x, y))
        if not len(keys_a) or not len(keys_b):
            return pa.table({"one": keys_a.slice(0, 0), "two": keys_b.slice(0, 0), "similarity": pa.array([], pa.float64())})
        order = pc.sort_indices(keys_b)  # a stable cut then keeps the smaller key
        keys_b = keys_b.take(order)
        m, n = matrix(x), matrix(y)[order.to_numpy()]
        norm_a, norm_b = np.sqrt((m * m).sum(1)), np.sqrt((n * n).sum(1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        index: dict[object, list[int]] = {}
        for i, k in enumerate(keys_b.to_pylist() if others else []):
            index.setdefault(k, []).append(i)
        strip = max(1, CELLS // len(n))
        for s in range(0, len(m), strip):
            both = norm_a[s : s + strip, None] * norm_b
            cos = np.divide(m[s : s + strip] @ n.T, both, out=np.zeros_like(both), where=both > 0)
            if others:
                for r, k in enumerate(keys_a.slice(s, strip).to_pylist()):
                    if (at := index.get(k)) is not None:
                        cos[r, at] = -np.inf
            passed = cos > floor if strict else cos >= floor
            if most is not None and most < len(n):
                cut = -np.partition(-cos, most - 1, axis=1)[:, most - 1]
                passed &= cos >= cut[:, None]
            r, c = np.nonzero(passed)
            found.append((r + s, c, cos[r, c]))
        r, c, v = (np.concatenate(z) for z in zip(*found))
        return pa.table({"one": keys_a.take(pa.array(r)), "two": keys_b.take(pa.array(c)), "similarity": pa.array(v)})

    cells = one.groupBy(*_GROUP, "i", "j").cogroup(two.groupBy(*_GROUP, "i", "j")).applyInArrow(run, f"one {kinds[0]}, two {kinds[1]}, similarity double")
    if most is not None:
        w = Window.partitionBy("one").orderBy(F.desc("similarity"), "two")
        cells = cells.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return cells.select(F.col("one").alias(left_key), F.col("two").alias(right_key), "similarity")
