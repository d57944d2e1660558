"""Embedding near-dedup: epsilon grid order join of vectors within a label.

Two unit vectors of cosine >= c lie within eps = sqrt(2 - 2 c) of each other, in every orthogonal projection too. Vectors
are projected on their leading principal directions (covariance summed over all rows), laid on a grid of width eps and
sorted by cell; the sequence is cut into blocks, and blocks into intervals of `_FAN` that nest. Intervals are joined
recursively: a pair whose bounding boxes come within eps over all leading directions goes on to the pairs of its parts,
others are provably distant and skipped. Pairs of blocks that are left are dealt to tasks by tile, so that a block travels
once to each pair of tiles; there a pair is halved further down to leaves that compute exact cosines in double precision
from the given components. Equal vectors of a label (by a 128-bit digest) collapse to one with a multiplicity first, so
copies are counted but never expanded. At a distance that a fixed eps cannot tell apart in the leading directions,
comparisons grow with the square of a label's vectors, and what travels with that over a tile's size.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link
with nothing and form components of their own; vectors of different lengths never link; rows with a null id are left out;
a repeated row counts as one more vector.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import components, small, written

#: Principal directions of the grid and of the bounding boxes, vectors of a block, and of a leaf.
_DIRECTIONS = 12
_BLOCK = 512
_LEAF = 128
#: Parts of an interval, and blocks of a tile.
_FAN, _TILE = 8, 32
#: Classes (48 bytes each) up to which they are broadcast to the vectors.
_CLASSES = 1_000_000


_KIND = np.dtype("<f8")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stacked(column: pa.Array) -> np.ndarray:
    """Vectors of one length from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), _KIND).reshape(len(column), -1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dims, hi, lo, v): vectors as bytes of doubles, with a digest; dims is 0 for those that cannot link."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            blobs, dims = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = np.array([], _KIND) if label is None or not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(_KIND)
                fit = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                dims.append(len(x) if fit else 0)
                blobs.append(x.tobytes() if fit else b"")
            both = np.frombuffer(b"".join(hashlib.blake2b(b, digest_size=16).digest() for b in blobs), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(blobs, pa.binary())], ["vec_id", "label", "dims", "hi", "lo", "v"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum and the sum of squares of a partition's unit vectors, as one row."""
    n, total, square = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            u = _unit(_stacked(batch.column(0)))
            n, total, square = n + len(u), total + u.sum(axis=0), square + u.T @ u
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([float(n)]), pa.array([total]), pa.array([square.ravel()])], ["one", "n", "s", "m"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"one": [0], "n": [rows["n"].sum()], "s": [np.sum(rows["s"].tolist(), axis=0)], "m": [np.sum(rows["m"].tolist(), axis=0)]})


def principal_directions(vectors: DataFrame, dims: int) -> np.ndarray:
    """dims x k leading directions; what meets is one dims x dims matrix a partition, then a folder of partitions."""
    schema = "one long, n double, s array<double>, m array<double>"
    parts = vectors.where(F.col("dims") == dims).select("v").mapInArrow(_moments, schema)
    parts = parts.groupBy((F.spark_partition_id() % 64).alias("folder")).applyInPandas(_summed, schema)
    row = parts.groupBy("one").applyInPandas(_summed, schema).first()
    if row is None:
        return np.zeros((dims, _DIRECTIONS))
    mean, square = np.array(row["s"]) / row["n"], np.array(row["m"]).reshape(dims, dims) / row["n"]
    top = np.linalg.eigh(square - np.outer(mean, mean))[1][:, ::-1][:, :_DIRECTIONS]
    return np.pad(top, ((0, 0), (0, _DIRECTIONS - top.shape[1])))


def _cells(directions: np.ndarray, eps: float):
    """Grid cells on the leading directions; vectors of other lengths than the usual one all lie in cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.zeros(batch.num_rows, np.int32) for _ in range(_DIRECTIONS)]
            usual = batch.column("dims").to_numpy() == len(directions)
            if usual.any():
                at = np.floor(_unit(_stacked(batch.column("v").filter(pa.array(usual)))) @ directions / eps).astype(np.int32)
                for c in range(_DIRECTIONS):
                    columns[c][usual] = at[:, c]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], names=[*batch.schema.names, *(f"g{c}" for c in range(_DIRECTIONS))])

    return run


def _blocks(directions: np.ndarray):
    """Cut sorted rows into blocks of one label and length, each with the bounding box of its projections."""

    def cut(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        label, dims = rows.column("label").to_numpy(), rows.column("dims").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((label[1:] != label[:-1]) | (dims[1:] != dims[:-1])) + 1, [len(label)]])
        for a, b in zip(edges[:-1], edges[1:]):
            for at in range(a, b, _BLOCK):
                part = rows.slice(at, min(_BLOCK, b - at)).combine_chunks()
                x = _stacked(part.column("v").combine_chunks())
                u = _unit(x)
                on = u @ directions if u.shape[1] == len(directions) else np.zeros((len(u), _DIRECTIONS))
                blobs = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("node", "copies")] + [x.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([int(label[a])], pa.int64()), pa.array([int(dims[a])], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs), pa.array([on.min(axis=0)]), pa.array([on.max(axis=0)])], ["label", "dims", "nodes", "copies", "units", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = np.full((4, 1), -1, np.int64)
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("label", "dims", "node", "hi")])
            fresh = (now != np.concatenate([last, now[:, :-1]], axis=1)).any(axis=0)  # a repeated row is sorted behind its first
            last = now[:, -1:] if batch.num_rows else last
            held.append(batch.filter(pa.array(fresh)))
            if sum(b.num_rows for b in held) >= 16 * _BLOCK:
                yield from cut(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield from cut(pa.Table.from_batches(held))

    return run


def _leaves(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of leaves whose bounding boxes come within eps."""
    todo = [(a, b)]
    while todo:
        i, j = todo.pop()
        gap = np.maximum(p[i].min(axis=0) - q[j].max(axis=0), q[j].min(axis=0) - p[i].max(axis=0))
        if (np.maximum(gap, 0) ** 2).sum() > (eps + 1e-6) ** 2:
            continue
        if max(len(i), len(j)) <= _LEAF:
            yield i, j
        elif len(i) >= len(j):
            todo += [(i[: len(i) // 2], j), (i[len(i) // 2 :], j)]
        else:
            todo += [(i, j[: len(j) // 2]), (i, j[len(j) // 2 :])]


def _compared(directions: np.ndarray, cosine: float, eps: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One pair of tiles: each of its blocks once, those of the first tile with the blocks to compare them with."""
        dims = int(rows["dims"].iloc[0])
        units = {b: _unit(np.frombuffer(x, _KIND).reshape(-1, dims)) for b, x in zip(rows["block"], rows["units"])}
        on = {b: u @ directions if dims == len(directions) else np.zeros((len(u), 1)) for b, u in units.items()}
        first = dict(zip(units, np.cumsum([0, *map(len, units.values())])))
        nodes, copies = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]) for c in ("nodes", "copies"))
        links, pairs = np.zeros(len(nodes), np.int64), [np.empty((2, 0), np.int64)]
        for one, others in zip(rows["block"], rows["others"]):
            for two in () if others is None else others:
                x, y, same = units[one], units[two], one == two
                for i, j in _leaves(np.arange(len(x)), np.arange(len(y)), on[one], on[two], eps):
                    near = x[i] @ y[j].T >= cosine
                    if same:
                        near &= i[:, None] != j[None, :]
                    links[first[one] + i] += near @ copies[first[two] + j]
                    if not same:
                        links[first[two] + j] += near.T @ copies[first[one] + i]
                    a, b = np.nonzero(near)
                    pairs.append(np.stack([first[one] + i[a], first[two] + j[b]]))
        a, b = np.concatenate(pairs, axis=1)
        root = np.arange(len(nodes))
        while len(a):  # smallest label within these blocks
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        hit = links > 0
        return pd.DataFrame({"a": nodes[hit], "b": nodes[root][hit], "links": links[hit]})

    return run


def _merged(boxes: DataFrame) -> DataFrame:
    """Boxes (label, dims, at, lo, hi) of the intervals one level up."""
    corner = lambda f, c: F.array(*(f(F.col(c)[k]) for k in range(_DIRECTIONS))).alias(c)
    return boxes.groupBy("label", "dims", F.floor(F.col("at") / _FAN).alias("at")).agg(corner(F.min, "lo"), corner(F.max, "hi"))


def _near_blocks(boxes: DataFrame, eps: float) -> DataFrame:
    """(label, dims, p, q), p <= q: pairs of blocks whose boxes come within eps, found from the widest intervals down."""
    levels = [boxes]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) >= _FAN:
        levels.append(written(_merged(levels[-1]), "intervals"))
    gap = F.zip_with(F.zip_with("lo", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    close = F.aggregate(gap, F.lit(0.0), lambda s, d: s + d * d) <= (eps + 1e-6) ** 2
    part = lambda c: F.explode(F.sequence(F.col(c) * _FAN, F.col(c) * _FAN + _FAN - 1)).alias(c)
    pairs = levels[-1].select("label", "dims").distinct().select("label", "dims", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
    for level in reversed(levels):
        parts = pairs.select("label", "dims", part("p"), "q").select("label", "dims", "p", part("q")).where("p <= q")
        one = level.withColumnRenamed("at", "p")
        two = level.select("label", "dims", F.col("at").alias("q"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        pairs = written(parts.join(one, ["label", "dims", "p"]).join(two, ["label", "dims", "q"]).where(close).select("label", "dims", "p", "q"), "pairs")
    return pairs


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept): rows of one label are linked at a cosine of at least `cosine`."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    given = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    keyed = given.mapInArrow(_keyed, "vec_id long, label long, dims int, hi long, lo long, v binary")
    keys = written(keyed.drop("v"), "keys")
    classes = written(keys.where("dims > 0").groupBy("label", "dims", "hi", "lo").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "classes")
    usual = classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    alone = keys.where("dims = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if usual is None:
        return alone
    vectors = keyed.where("dims > 0").join(small(classes.select(F.col("label").alias("label_"), F.col("node").alias("vec_id"), F.col("hi").alias("hi_"), F.col("lo").alias("lo_"), "copies"), _CLASSES), "vec_id").where("label = label_ AND hi = hi_ AND lo = lo_")
    vectors = vectors.select("label", "dims", F.col("vec_id").alias("node"), "hi", "copies", "v")
    directions = principal_directions(vectors, usual["dims"])
    grid = [f"g{c}" for c in range(_DIRECTIONS)]
    celled = vectors.mapInArrow(_cells(directions, eps), "label long, dims int, node long, hi long, copies long, v binary, " + ", ".join(f"{g} int" for g in grid))
    ordered = celled.repartitionByRange("label", "dims", *grid, "node", "hi").sortWithinPartitions("label", "dims", *grid, "node", "hi")
    schema = "label long, dims int, nodes binary, copies binary, units binary, lo array<double>, hi array<double>"
    blocks = written(ordered.mapInArrow(_blocks(directions), schema).withColumn("block", F.monotonically_increasing_id()), "blocks")
    numbered = blocks.select("label", "dims", "block").withColumn("at", F.row_number().over(Window.partitionBy("label", "dims").orderBy("block")).cast("long") - 1)
    boxes = written(numbered.select("block", "at").join(blocks.select("label", "dims", "block", "lo", "hi"), "block"), "boxes")
    pairs = _near_blocks(boxes.drop("block"), eps)
    tile = lambda c: F.floor(F.col(c) / _TILE)
    pairs = pairs.withColumns({"t": tile("p"), "u": tile("q")})
    sides = pairs.groupBy("label", "dims", "t", "u", F.col("p").alias("at")).agg(F.collect_set("q").alias("others")).unionByName(pairs.select("label", "dims", "t", "u", F.col("q").alias("at"), F.lit(None).cast("array<long>").alias("others")))
    sides = sides.groupBy("label", "dims", "t", "u", "at").agg(F.flatten(F.collect_list("others")).alias("others"))  # a tile's blocks at most
    sides = sides.join(boxes.select("label", "dims", "at", "block"), ["label", "dims", "at"]).select("t", "u", "block", "at", "others")
    held = blocks.select("block", "label", "dims", "nodes", "copies", "units")
    found = sides.join(held, "block").select("label", "dims", "t", "u", F.col("at").alias("block"), "others", "nodes", "copies", "units")
    found = written(found.groupBy("label", "dims", "t", "u").applyInPandas(_compared(directions, cosine, eps), "a long, b long, links long"), "links")
    labels = components(found.select("a", "b")).select(F.col("node"), "component")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.join(counts, "node", "left").join(labels, "node", "left").select("label", "dims", "hi", "lo", F.coalesce("component", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = keys.where("dims > 0").join(written(named, "named"), ["label", "dims", "hi", "lo"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
