"""What the operators of this package share: tables in the shared folder, word and shingle kernels, components.

Defined cases: a null text counts as an empty one; rows without an id take no part (they could not be named in a
result); extra columns never reach an operator because each selects the columns it was told by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: the bytes 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII signs other than letters and digits.
_SIGNS = _SPACE.copy()
_SIGNS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SMALL = _LOWER.astype(np.uint8)
_LOWER += 1
_SLICE = 1 << 20
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may name none: its tables go under /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file:///tmp/checkpoints/larkspur").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and a lost executor costs only a reread."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables were written so far; see release."""
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written after `since`, once nothing lazy reads them any more."""
    for path in _made[since:]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _made[since:]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near values give unrelated ones."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(n, 1), 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges start:end, A-Z lowered; empty ranges hash to 0."""
    out, size = np.zeros(len(start), np.uint64), end - start
    if not size.all():
        some = size > 0
        out[some] = hashed(raw, start[some], end[some])
        return out
    power = _powers(int(size.max(initial=0)))
    done = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(start):  # a few megabytes at a time, as eight bytes are held for each
        b = max(a + 1, int(np.searchsorted(done, done[a] + _SLICE, "right")) - 1)
        first = done[a:b] - done[a]
        within = np.arange(done[b] - done[a]) - np.repeat(first, size[a:b])
        at = within + np.repeat(start[a:b], size[a:b])
        out[a:b] = np.add.reduceat(_LOWER[raw[at]] * power[within], first)
        a = b
    return mix(out ^ size.astype(np.uint64))


def lowered(raw: np.ndarray) -> np.ndarray:
    return _SMALL[raw]


def alike(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, at: np.ndarray) -> bool:
    """Whether the byte ranges start:end, A-Z lowered, are those of the same sizes in `other` from `at` on."""
    size = end - start
    done, a = np.concatenate([[0], np.cumsum(size)]), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(done, done[a] + _SLICE, "right")) - 1)
        within = np.arange(done[b] - done[a]) - np.repeat(done[a:b] - done[a], size[a:b])
        one, two = within + np.repeat(start[a:b], size[a:b]), within + np.repeat(at[a:b], size[a:b])
        if two.max(initial=0) >= len(other) or not np.array_equal(_SMALL[raw[one]], other[two]):
            return False
        a = b
    return True


def held(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value among sorted ones, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


class Words:
    """The words (runs of other bytes than ASCII white space, A-Z lowered) of a column of texts, hashed to 64 bits.

    bounds[i]:bounds[i+1] are the words of text i in hashes. With signs=False, ASCII signs part words too.
    """

    def __init__(self, texts: pa.Array, signs: bool = True):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        gap = (_SPACE if signs else _SIGNS)[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[off] = True
        before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
        before[1:] = gap[:-1]
        after[:-1] = gap[1:]
        start = np.flatnonzero(~gap & (before | cut[:-1]))
        end = np.flatnonzero(~gap & (after | cut[1:])) + 1
        self.raw, self.start, self.end = raw, start, end
        self.bounds = np.searchsorted(start, off)

    @cached_property
    def hashes(self) -> np.ndarray:
        return hashed(self.raw, self.start, self.end)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def spelled(self, which: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Lowered bytes of some words, each led by `before` bytes 1 and ended by a byte 2; and the place of each's lead."""
        size = self.end[which] - self.start[which]
        lead = np.concatenate([[0], np.cumsum(size + before + 1)])
        out = np.full(lead[-1], 1, np.uint8)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(lead[:-1] + before, size) + within] = (_LOWER[self.raw[np.repeat(self.start[which], size) + within]] - 1).astype(np.uint8)
        out[lead[1:] - 1] = 2
        return out, lead

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def slices(batch: pa.RecordBatch, text: int, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `most` bytes of text (or one row), so that what a worker holds does not follow row sizes."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.concatenate([[0], np.cumsum(size)]), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles as sorted 64-bit hashes; of fewer words, the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    key = _powers(max(k, n if n < k else k))
    if n < k:
        return mix((words * key[:n]).sum(keepdims=True) + np.uint64(n))
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h += words[j : n - k + 1 + j] * key[j]
    return np.unique(mix(h + np.uint64(k)))


def hash01(*cols: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols, F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def small(df: DataFrame, limit: int) -> DataFrame:
    """df marked for broadcast if it has at most `limit` rows (counted), else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of `edges` (a, b): component is the smallest node that can be reached.

    Smallest labels pass along edges and pointers are halved each round; aggregates combine before the shuffle and joins
    read written tables, so a node with very many edges does not gather them in one task.
    """
    e = edges.where("a <> b").select("a", "b")
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(e.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = e.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        lower = written(lower, "labels")
        to = lower.select(F.col("node").alias("component"), F.col("component").alias("to"))
        jumped = lower.join(to, "component", "left").select("node", "was", F.least(F.col("component"), F.col("to")).alias("component"))
        labels = written(jumped, "labels")
        if labels.where("component <> was").isEmpty():
            return labels.select("node", "component")


def prefix_sums(counts: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """counts with `before`: the sum of value over smaller `order`; counts holds a bounded number of rows per group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))
