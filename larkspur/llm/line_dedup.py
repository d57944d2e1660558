"""Line dedup that can be taken back: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line stripped of ASCII white space with A-Z lowered; keys shorter than `MIN_CHARS` code points never
count. State, all of it tables sharded by key: `holders` (which document holds which key, exact), `counts` (per key the
number of documents and the smallest id) and one cuckoo filter a shard, which holds the fingerprints of the keys with two
documents or more. `insert` and `delete` write only what they touch: rows of the new documents, counts of their keys, and
filters of shards where a key's count crosses two; deleting documents restores the state before them. A probe of the filter sorts out lines that are surely unshared; possible hits
are settled by an exact join with the counts, so a false positive never drops a line.

Defined cases: a null or empty text is one empty line and stays; rows with a null id are left out; repeated rows of an id
are one document; an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from larkspur.llm.common import slices, written

MIN_CHARS = 10
#: Keys that a shard's filter should hold, and lines that one probing task takes.
_SHARD = 32_768
_PROBE = 8_192
#: Bytes of all filters up to which they are broadcast to the lines, bytes of text taken at once, and updates of a state
#: between two rewrites of its tables.
_FILTERS = 32 << 20
_TEXTS = 2 << 20
_UPDATES = 8
_SLOTS = 4
_KICKS = 500


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or sum((b & 0xC0) != 0x80 for b in key[: 4 * least]) >= least)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, _TEXTS)):
            docs, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = {_digest(k) for line in (text or "").encode().split(b"\n") if _long_enough(k := line_key(line), least)}
                docs += [doc] * len(keys)
                found += keys
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "hi", "lo"])

    return run


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; a fingerprint's other bucket follows from it and either bucket."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else table.copy()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(1, int(keys / (_SLOTS * 0.8))).bit_length())

    @classmethod
    def read(cls, blob: bytes) -> CuckooFilter:
        table = np.frombuffer(blob, np.uint16).reshape(-1, _SLOTS)
        return cls(len(table), table)

    def blob(self) -> bytes:
        return self.table.tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.view(np.uint64)
        print_ = ((h & np.uint64(0xFFFF)).astype(np.int64) % 0xFFFF) + 1
        one = ((h >> np.uint64(16)).astype(np.int64)) & self.mask
        return print_, one, self.other(one, print_)

    def other(self, bucket, print_):
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        print_, one, two = self.places(hashes)
        return ((self.table[one] == print_[:, None]) | (self.table[two] == print_[:, None])).any(axis=1)

    def add(self, hashes: np.ndarray) -> bool:
        """False if there was no room; the filter must then be rebuilt larger from the counts."""
        for p, a, b in zip(*(x.tolist() for x in self.places(hashes))):
            for kick in range(_KICKS):
                room = next((x for x in (a, b) if not self.table[x].all()), None)
                if room is not None:
                    self.table[room, int(np.argmin(self.table[room]))] = p
                    break
                slot = (p + kick) % _SLOTS
                p, self.table[a, slot] = int(self.table[a, slot]), p
                a = int(self.other(a, p))
                b = a
            else:
                return False
        return True

    def remove(self, hashes: np.ndarray) -> None:
        for p, a, b in zip(*(x.tolist() for x in self.places(hashes))):
            at = next(((x, s) for x in (a, b) for s in range(_SLOTS) if self.table[x, s] == p), None)
            if at:
                self.table[at] = 0


def _built(hashes: np.ndarray) -> bytes:
    n = len(hashes)
    while not (f := CuckooFilter.sized(n)).add(hashes):
        n *= 2
    return f.blob()


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "filter": [_built(rows["hi"].to_numpy())]})


def _change(key: tuple, filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after keys came (sign 1) and went (sign -1); `all` rows refill it where there is no room."""
    hi, sign = rows["hi"].to_numpy(), rows["sign"].to_numpy()
    f = CuckooFilter.read(filters["filter"].iloc[0]) if len(filters) else CuckooFilter.sized(int((sign > 0).sum()) + 1)
    f.remove(hi[sign < 0])
    ok = f.add(hi[sign > 0])
    return pd.DataFrame({"shard": [key[0]], "filter": [f.blob() if ok else None]})


def _probe(key: tuple, filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    if len(filters) and len(rows):
        rows = rows[CuckooFilter.read(filters["filter"].iloc[0]).holds(rows["hi"].to_numpy())]
    else:
        rows = rows.iloc[:0]
    return rows[["doc_id", "hi", "lo"]]


def _probed(filters):
    """Rows (doc_id, hi, lo, shard) that a broadcast filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = {shard: CuckooFilter.read(blob) for shard, blob in filters.value.items()}
        for batch in batches:
            hi, shard = (batch.column(c).to_numpy() for c in (1, 3))
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(order) else np.empty(0, np.int64)
            hit = np.zeros(len(hi), bool)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
                if (f := read.get(int(shard[order[a]]))) is not None:
                    hit[order[a:b]] = f.holds(hi[order[a:b]])
            yield batch.filter(pa.array(hit)).select([0, 1, 2])

    return run


@dataclass
class LineState:
    shards: int
    holders: DataFrame  # doc_id, hi, lo, shard
    counts: DataFrame  # hi, lo, shard, docs, first
    filters: DataFrame  # shard, filter
    updates: int = 0  # since the tables were last written whole


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")


def _count(holders: DataFrame) -> DataFrame:
    return holders.groupBy("hi", "lo", "shard").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


def _stated(held: DataFrame) -> LineState:
    plain = written(held.groupBy("hi", "lo").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")), "counts")
    shards = max(1, -(-plain.where("docs > 1").count() // _SHARD))
    shard = F.pmod(F.col("lo"), F.lit(shards)).cast("int").alias("shard")
    counts = plain.select("hi", "lo", shard, "docs", "first")
    filters = written(counts.where("docs > 1").groupBy("shard").applyInPandas(_build, "shard int, filter binary"), "filters")
    return LineState(shards, held.select("doc_id", "hi", "lo", shard), counts, filters)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> LineState:
    """The state of a corpus loaded at once."""
    return _stated(written(_texts(docs, id_col, text_col).mapInArrow(_lines(min_chars), "doc_id long, hi long, lo long").distinct(), "holders"))


def _moved(state: LineState, holders: DataFrame, touched: DataFrame) -> LineState:
    """The state with new holders. Only counts of touched keys and filters of shards where one crossed two are written; the
    rest is read from the tables before, until `_UPDATES` updates have come and all is written anew."""
    before, fresh = written(state.counts.join(touched, ["hi", "lo"], "left_semi"), "before"), written(_count(holders.join(touched, ["hi", "lo"], "left_semi")), "counts")
    was, now = before.where("docs > 1").select("hi", "lo", "shard"), fresh.where("docs > 1").select("hi", "lo", "shard")
    came = now.join(was, ["hi", "lo"], "left_anti").withColumn("sign", F.lit(1))
    went = was.join(now, ["hi", "lo"], "left_anti").withColumn("sign", F.lit(-1))
    change = written(came.unionByName(went), "change")
    shards = change.select("shard").distinct()
    counts = state.counts.join(touched, ["hi", "lo"], "left_anti").unionByName(fresh)
    changed = written(state.filters.join(shards, "shard", "left_semi").groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(_change, "shard int, filter binary"), "filters")
    full = changed.where("filter is null").select("shard")
    refilled = counts.where("docs > 1").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build, "shard int, filter binary")
    changed = written(changed.where("filter is not null").unionByName(refilled), "filters")
    filters = state.filters.join(shards, "shard", "left_anti").unionByName(changed)
    moved = LineState(state.shards, holders, counts, filters, state.updates + 1)
    return compacted(moved) if moved.updates >= _UPDATES else moved


def compacted(state: LineState) -> LineState:
    """The same state as whole tables, with a number of shards that fits it."""
    return _stated(written(state.holders.select("doc_id", "hi", "lo"), "holders"))


def insert(state: LineState, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> LineState:
    """The state after documents came; an id that is there already is the same document and gains these lines."""
    shard = F.pmod(F.col("lo"), F.lit(state.shards)).cast("int").alias("shard")
    new = written(_texts(docs, id_col, text_col).mapInArrow(_lines(min_chars), "doc_id long, hi long, lo long").distinct().select("doc_id", "hi", "lo", shard), "new")
    return _moved(state, state.holders.unionByName(new).distinct(), new.select("hi", "lo").distinct())


def delete(state: LineState, ids: DataFrame, id_col: str = "doc_id") -> LineState:
    """The state after documents went, as if they had never been inserted."""
    gone = written(ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "gone")
    touched = written(state.holders.join(gone, "doc_id", "left_semi").select("hi", "lo").distinct(), "touched")
    return _moved(state, state.holders.join(gone, "doc_id", "left_anti"), touched)


def _hits(state: LineState) -> DataFrame:
    """(doc_id, hi, lo) that the filters may hold. Filters of up to `_FILTERS` bytes (summed) are broadcast, so that no row
    moves; beyond, holders meet their shard's filter in chunks, so a key that a third of the corpus holds spreads."""
    if (state.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= _FILTERS:
        filters = state.holders.sparkSession.sparkContext.broadcast({r.shard: bytes(r.filter) for r in state.filters.collect()})
        return state.holders.select("doc_id", "hi", "lo", "shard").mapInArrow(_probed(filters), "doc_id long, hi long, lo long")
    chunks = state.holders.groupBy("shard").agg(F.ceil(F.count("*") / _PROBE).cast("int").alias("chunks"))
    chunks = written(chunks.join(state.filters, "shard"), "chunks")
    filters = chunks.select("shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "filter")
    rows = state.holders.join(chunks.select("shard", "chunks"), "shard").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "hi"), F.col("chunks")).cast("int")).select("shard", "chunk", "doc_id", "hi", "lo")
    return filters.groupBy("shard", "chunk").cogroup(rows.groupBy("shard", "chunk")).applyInPandas(_probe, "doc_id long, hi long, lo long")


def lost_lines(state: LineState) -> DataFrame:
    """(doc_id, hi, lo): keys whose lines a document loses, as a smaller id holds them too.

    The exact join reads written tables, whose skewed keys adaptive execution splits.
    """
    shared = state.counts.where("docs > 1").select("hi", "lo", "first")
    return written(_hits(state), "hits").join(shared, ["hi", "lo"]).where("doc_id <> first").select("doc_id", "hi", "lo")


def _kept(at: int, least: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at, _TEXTS)):
            kept, lines, dropped = [], [], []
            for text, lost in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                parts = (text or "").encode().split(b"\n")
                left = parts
                if lost:
                    lost = {struct.pack("<qq", x["hi"], x["lo"]) for x in lost}
                    left = [x for x in parts if not (_long_enough(k := line_key(x), least) and _digest(k) in lost)]
                kept.append(b"\n".join(left).decode())
                lines.append(len(parts))
                dropped.append(len(parts) - len(left))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "kept__", "n_lines__", "n_dropped__"])

    return run


def _packed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("doc_id").alias("lost_id__")).agg(F.collect_list(F.struct("hi", "lo")).alias("lost__"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: LineState | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs' columns with `kept__` (the text that stays), `n_lines__` and `n_dropped__`.

    Shared lines stay only in the smallest id that holds them; all other lines stay in place, joined by newlines.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    state = state or build(docs, id_col, text_col, min_chars)
    lost = _packed(lost_lines(state))
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever docs' columns are called
    joined = rows.join(lost, rows[docs.columns.index(id_col)].cast("long") == lost["lost_id__"], "left").select(*rows.columns, lost["lost__"])
    schema = StructType([*docs.schema.fields, StructField("kept__", StringType()), StructField("n_lines__", LongType()), StructField("n_dropped__", LongType())])
    return joined.mapInArrow(_kept(docs.columns.index(text_col), min_chars, docs.columns), schema)
