"""Approximate vector search on inverted lists: vectors stored by their nearest centroid, searched in the nearest lists only.

Centroids come from k-means on unit vectors of a bounded sample (`SAMPLE` rows by hash); every vector is indexed. The number of
lists follows the size rule of `vector.index_lists`, or is given for larger collections. A list's rows lie in a folder of
their own, with the least cosine of any of them to the centroid, which bounds what the list can hold: a search that is to be exact
reads on until no list that is left can hold a better row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import vector
from larkspur.operators import matrix, rank
from larkspur.sources.shared import kept

#: Rows that the centroids are fitted on, at most; rows a file of a list holds.
SAMPLE, FILE = 50_000, 1_000_000


def lists_for(n: int) -> int:
    """`vector.index_lists` for a number that is known."""
    return min(2 if n < 100 else 10 if n < 1000 else 50, n)


class VectorIndex:
    """A folder of lists. `build` writes it, the constructor opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = spark.read.parquet(f"{self.path}/lists")
        lists = spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()  # as many as there are lists
        self.sizes, self.least = np.array([r["n"] for r in lists]), np.array([r["least"] for r in lists])
        self.numbers, self.centroids = np.array([r["list"] for r in lists]), np.array([r["centroid"] for r in lists])

    @classmethod
    def build(cls, rows: DataFrame, key: str, column: str, path: str, lists: int | None = None, seed: int = 5) -> VectorIndex:
        """Rows without a key or with a null, empty or zero vector or null components are left out."""
        spark, v = rows.sparkSession, F.col(column).cast("array<double>")
        usable = rows.where(F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull()) & F.exists(v, lambda x: x != 0)).withColumn("v__", v)
        n = usable.count()
        share = min(1.0, SAMPLE / max(n, 1))
        unit = F.transform(F.array(vector.norm(F.col("v__"))), lambda n: F.transform("v__", lambda x: x / n))[0]  # one norm a row
        sample = kept(usable.where(F.xxhash64(F.col(key), F.lit(seed)) / F.lit(2.0**64) + 0.5 <= share).select(array_to_vector(unit).alias("features")), "sample")
        model = KMeans(k=max(2, lists or lists_for(n)), seed=seed, maxIter=15).fit(sample)
        centers = np.array(model.clusterCenters())
        centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u = b.column("v__")
                m = u.values.to_numpy(zero_copy_only=False)[u.offsets[0].as_py() : u.offsets[-1].as_py()].reshape(-1, centers.shape[1])
                cos = m @ centers.T / np.linalg.norm(m, axis=1, keepdims=True)
                best = cos.argmax(axis=1)
                yield b.drop_columns(["v__"]).append_column("list", pa.array(best, pa.int32())).append_column("near", pa.array(cos[np.arange(len(best)), best]))

        schema = usable.drop("v__").select("*", F.lit(0).cast("int").alias("list"), F.lit(0.0).alias("near")).schema
        parts = max(1, n // FILE)
        dealt = usable.mapInArrow(assigned, schema).repartition(max(1, len(centers) * parts), "list", F.pmod(F.xxhash64(key), F.lit(parts)))
        dealt.sortWithinPartitions("list", key).write.partitionBy("list").parquet(f"{path}/lists")
        stored = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("least"))
        centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, centroid array<double>")
        stored.join(F.broadcast(centroids), "list").coalesce(1).write.parquet(f"{path}/centroids")
        return cls(spark, path)

    def nearest(self, query: list[float], probes: int) -> list[int]:
        order = np.argsort(-(self.centroids @ np.array(query, float)), kind="stable")
        return self.numbers[order[:probes]].tolist()

    def search(self, query: list[float], column: str, key: str, n: int, probes: int = 8) -> DataFrame:
        """The n best rows of the nearest lists, with `score`."""
        return rank.vector_search(self.rows.where(F.col("list").isin(self.nearest(query, probes))), column, query, n, key)

    def certified(self, query: list[float], column: str, key: str, n: int, probes: int = 8) -> DataFrame:
        """The n best of all rows: after the nearest lists, every list whose rows could still be nearer than the n-th is read.
        What lies at an angle of at most r from a centroid is at least the query's angle to it less r away."""
        q = np.array(query, float)
        angle = np.arccos(np.clip(self.centroids @ (q / max(np.linalg.norm(q), 1e-300)), -1, 1))
        bound = np.cos(np.maximum(angle - np.arccos(np.clip(self.least, -1, 1)), 0)) + 1e-9
        first = self.search(query, column, key, n, probes).select("score").collect()
        floor = first[-1]["score"] if len(first) == n else -np.inf
        wanted = {*self.nearest(query, probes), *self.numbers[bound >= floor].tolist()}
        return rank.vector_search(self.rows.where(F.col("list").isin(sorted(wanted))), column, query, n, key)

    def search_many(self, queries: DataFrame, query_key: str, column: str, key: str, n: int, probes: int = 8) -> DataFrame:
        """(query_key, key, similarity): the n best other rows of each query's nearest lists, by products of tiles of a list."""
        centers, numbers = self.centroids, self.numbers
        kind = dict(queries.dtypes)[query_key]

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column("v")
                m = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[-1].as_py()].reshape(-1, centers.shape[1])
                order = np.argsort(-(m @ centers.T), axis=1, kind="stable")[:, :probes]
                rows = np.repeat(np.arange(len(m)), order.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), v.take(pa.array(rows)), pa.array(numbers[order.ravel()], pa.int32())], [query_key, column, "list"])

        v = F.col(column).cast("array<double>")
        asked = queries.where(F.col(query_key).isNotNull() & (F.size(v) == centers.shape[1]) & F.forall(v, lambda x: x.isNotNull())).select(query_key, v.alias("v")).mapInArrow(probed, f"`{query_key}` {kind}, `{column}` array<double>, list int")
        return matrix.best_matches(asked, self.rows, query_key, key, column, -2.0, n, F.col("list"))

    def share_read(self, queries: DataFrame, column: str, probes: int) -> DataFrame:
        """One row: the mean share of all rows that a query's lists hold."""
        sizes, centers = self.sizes / self.sizes.sum(), self.centroids

        @F.pandas_udf("double")
        def share(v):
            m = np.stack(v.to_numpy()).astype(float)
            import pandas as pd

            return pd.Series(sizes[np.argsort(-(m @ centers.T), axis=1)[:, :probes]].sum(axis=1))

        return queries.agg(F.avg(share(F.col(column).cast("array<double>"))).alias("share_read"))
