"""Exact top-k search by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors are quantised to whole numbers, so scores are exact. Rows are cut into blocks; each block keeps one list a
dimension, sorted by that component. A query walks its lists from the favourable end (the largest component for a
positive weight, the smallest for a negative one), those of much weight and spread deeper than others, scores what it
meets by random access, and stops in a block as soon as the score of a vector made of the components at the current depths
cannot beat the kth result. That result is a global one: before the walk, each query scores the rows that head the lists
of the whole table (`_HEADS` from both ends of each dimension), whose kth best score no true kth result falls below, so a
block that cannot beat it is left without scoring a row. Results of the blocks merge per query. Queries are a stated set
and travel in parts to every block of rows.

How much that saves depends on the data: where vectors differ in few dimensions most rows are never scored (`scored` in
`searched` counts them); with some 64 dimensions of like spread the bound stays above the kth score until nearly all rows
are met, and the walk is a scan.

Defined cases: vectors that are null, of another dimension than the longest of the table, or that hold null or non-finite
components take no part; ties go to the smaller id; repeated rows are rows of their own; an empty table gives an empty
result. Scores must fit a 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import written

#: Rows and queries of one block, rows at either end of a dimension's list that all queries score first.
ROWS, QUERIES, _HEADS = 4096, 2048, 16
_DEPTH = 16


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, x): floor(scale * component) as whole numbers, for the vectors that take part."""
    v = F.col(vector_col)
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & (F.size(v) > 0)
    return vectors.where(F.col(id_col).isNotNull()).where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("x"))


class _Lists:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)
        self.spread = self.sorted[-1] - self.sorted[0]

    def best(self, me: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best other rows that reach floor, ties to smaller ids, and how many rows were scored."""
        n, dims, up = len(self.ids), np.arange(len(q)), q > 0
        pull = np.abs(q) * np.maximum(self.spread, 1)
        pull = pull / max(pull.max(), 1)
        seen = np.zeros(n, bool)
        places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, walked = np.zeros(len(q), np.int64), 0
        while True:
            edge = np.where(up, self.sorted[n - 1 - np.minimum(depth, n - 1), dims], self.sorted[np.minimum(depth, n - 1), dims])
            least = max((x for x in (floor, int(scores.min()) if len(places) >= k else None) if x is not None), default=None)
            if seen.all() or (least is not None and int(edge @ q) < least):  # equal scores may still win by a smaller id
                return places, scores, int(seen.sum())
            walked = walked * 2 + _DEPTH
            to = np.minimum(n, np.maximum(depth, np.ceil(walked * pull).astype(np.int64)))
            fresh = np.zeros(n, bool)
            if (to >= n).any():  # one list is through, so every row is met
                fresh[:] = True
            for d in np.flatnonzero(to > depth) if not fresh.any() else ():
                fresh[self.order[n - to[d] : n - depth[d], d] if up[d] else self.order[depth[d] : to[d], d]] = True
            new, depth = np.flatnonzero(fresh & ~seen), to
            seen |= fresh
            new_scores, other = self.x[new] @ q, self.ids[new] != me
            places, scores = np.concatenate([places, new[other]]), np.concatenate([scores, new_scores[other]])
            if len(places) > k:
                top = np.lexsort((self.ids[places], -scores))[:k]
                places, scores = places[top], scores[top]


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them all, led by that number."""
    width = next(w for w in (1, 2, 4, 8) if not x.size or (x.min() >= -(1 << 8 * w - 1) and x.max() < 1 << 8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _blocks(most: int):
    """Rows (id, x) packed into blocks of at most `most`: ids and components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                x = part.column(1).flatten().to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([_bytes(x)], pa.binary())], ["ids", "x"])

    return run


def _read(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(b, np.int64) for b in rows["ids"]])
    return ids, np.concatenate([np.frombuffer(b, f"<i{b[0]}", offset=1) for b in rows["x"]]).reshape(len(ids), -1).astype(np.int64)


def _floors(heads: tuple[np.ndarray, np.ndarray], k: int):
    """(ids, x, floors) of queries: the kth best score among the heads, or the least 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = _read(pd.DataFrame([r]))
                scores = x @ heads[1].T
                low = np.iinfo(np.int64).min
                scores[ids[:, None] == heads[0][None, :]] = low
                floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), low)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (r["ids"], r["x"], floor.tobytes())], ["ids", "x", "floors"])

    return run


def _headed(most: int):
    """Of one partition, the rows that head some dimension's list at either end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.empty(0, np.int64), None
        for batch in batches:
            for r in batch.to_pylist():
                more, y = _read(pd.DataFrame([r]))
                ids, x = np.concatenate([ids, more]), y if x is None else np.concatenate([x, y])
                n = len(ids)
                order = np.argsort(x, axis=0, kind="stable")
                keep = np.unique(np.concatenate([order[:most].ravel(), order[max(0, n - most) :].ravel()]))
                ids, x = ids[keep], x[keep]
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([_bytes(x)], pa.binary())], ["ids", "x"])

    return run


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            lists, (asked, q) = _Lists(*_read(rows)), _read(queries)
            floors = np.concatenate([np.frombuffer(b, np.int64) for b in queries["floors"]])
            for me, w, floor in zip(asked, q, floors):
                places, scores, n = lists.best(me, w, k, None if floor == np.iinfo(np.int64).min else int(floor))
                keep = scores >= floor
                scored = np.zeros(max(1, int(keep.sum())), np.int64)
                scored[0] = n
                hits = {"vec_id": lists.ids[places[keep]], "score": scores[keep]} if keep.any() else {"vec_id": [None], "score": [None]}
                out.append(pd.DataFrame({"query_id": me, "scored": scored, **{c: pd.array(v, "Int64") for c, v in hits.items()}}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "scored": [], "vec_id": [], "score": []}, dtype=np.int64)

    return run


def searched(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score, scored): what each block finds; `scored` sums up to the rows that a query has scored.

    A block in which a query finds nothing gives one row without vec_id.
    """
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    blob = "ids binary, x binary"
    blocks = written(rows.where(F.size("x") == dims).select("vec_id", "x").mapInArrow(_blocks(ROWS), blob).withColumn("block", F.monotonically_increasing_id()), "rows")
    heads = blocks.select("ids", "x").mapInArrow(_headed(_HEADS), blob)
    parts = blocks.rdd.getNumPartitions()
    while parts > 1:  # partitions meet a few at a time, so that no task and not the driver holds more than some lists' heads
        parts = -(-parts // 16)
        heads = written(heads, "heads").coalesce(parts).mapInArrow(_headed(_HEADS), blob)
    known = heads.collect()  # 2 _HEADS rows a dimension at most
    top = _read(pd.DataFrame([r.asDict() for r in known])) if known else (np.empty(0, np.int64), np.empty((0, max(dims, 1)), np.int64))
    asked = queries.where(F.size("x") == dims).select("vec_id", "x").mapInArrow(_blocks(QUERIES), blob)
    asked = written(asked.mapInArrow(_floors(top, k), "ids binary, x binary, floors binary").withColumn("part", F.monotonically_increasing_id()), "queries")
    cells = written(blocks.select("block").crossJoin(asked.select("part")), "cells")  # names only: the stated queries meet all blocks
    one = cells.join(asked, "part").select(F.col("block").alias("to"), F.col("part").alias("of"), "ids", "x", "floors")
    two = cells.join(blocks, "block").select("block", "part", "ids", "x")
    return one.groupBy("to", "of").cogroup(two.groupBy("block", "part")).applyInPandas(_search(k), "query_id long, scored long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for quantised rows and queries (vec_id, x); a row never answers its own query."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = searched(rows, queries, k).where("vec_id IS NOT NULL")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
