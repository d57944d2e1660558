"""N-gram Jaccard join: an exact metric-space join of documents on the Jaccard distance of their word shingles.

1 - Jaccard is a metric, but on shingle sets it is 1 for almost all pairs, so pivots drawn from a whole corpus tell
nothing apart. The join therefore first cuts the corpus into candidate regions that no link crosses (extended prefixes of
the shingle sets, see `candidate_regions`), and joins each region in the metric: pivots create Voronoi regions, windows of
twice the radius (triangle inequality) replicate boundary documents, and regions are joined recursively; a leaf probes
exactly. A region above `REGION` documents is dealt over tasks by distance to its pivots. Texts with equal sets collapse
to the smallest id first, and pairs that are already in one component are not compared again, so copies are never
expanded into pairs. All documents and all shingles take part; there is no cap.

Defined cases: a null or empty text has no shingles and links with nothing; rows with a null id are left out; rows that
repeat an id are one document; ties of pivots go to the smaller hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Words, components, mix, shingles, slices, small, written

#: A region of more documents is dealt over tasks.
REGION = 192
_PIVOTS = 8
#: In larger ones: pivots, documents compared with them in one task, and documents of a block that others visit.
_STAR, _CHUNK, _BLOCK = 48, 96, 768
_LEAF = 24
#: Cells of one distance: more than set sizes have steps (a cell that wraps around only adds comparisons).
_ROW = 4096
#: Postings that one candidate bucket should hold, and the cells that they are counted in.
_BUCKET, _CELLS = 400_000, 1024
#: Postings of one shingle beyond which they do not go to its bucket but stay rows of their own.
_HOT = _BUCKET // 8
#: Low bits of a class key that hold the size of its set.
_SIZE = (1 << 20) - 1
#: Candidate documents up to which their ids (24 bytes each) are broadcast.
_BROADCAST = 1_000_000


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            words = Words(batch.column(1))
            sets = [shingles(words.of(i), k) for i in range(len(words))]
            digest = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
            both = np.frombuffer(digest, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "n", "hi", "lo"])

    return run


def _key(hi: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (hi & ~np.int64(_SIZE)) | np.minimum(n, _SIZE)


def _need(n, num: int, den: int):
    return -(-n * num // den)


def _extra(n, num: int, den: int):
    return np.maximum(1, n * (den - num) // den)


def _postings(k: int, num: int, den: int, buckets: int):
    """Of each distinct set in a batch, the extended prefix: its smallest hashes, so many that similar sets share several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            words, sets = Words(batch.column(0)), {}
            for i in range(len(words)):
                s = shingles(words.of(i), k)
                if len(s):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    hi = np.frombuffer(digest, np.int64)[0]
                    e = len(s) - _need(len(s), num, den) + int(_extra(len(s), num, den))
                    sets.setdefault(digest, (int(_key(hi, np.int64(len(s)))), s[:e]))
            if not sets:
                continue
            gram = mix(np.concatenate([s for _, s in sets.values()]) ^ np.uint64(0x5851F42D4C957F2D))
            key = np.repeat(np.array([k for k, _ in sets.values()], np.int64), [len(s) for _, s in sets.values()])
            bucket = ((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, gram, key = bucket[order], gram[order].view(np.int64), key[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            to = [*at[1:], len(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([gram[a:b].tobytes() for a, b in zip(at, to)], pa.binary()), pa.array([key[a:b].tobytes() for a, b in zip(at, to)], pa.binary())], ["bucket", "grams", "keys"])

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, cell, n): how many postings a cell of each bucket has, added up within the task."""
    held: dict[int, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        parts = [(np.full(len(at), b, np.int32), at, n[at]) for b, n in held.items() for at in [np.flatnonzero(n)]]
        held.clear()
        bucket, cell, n = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(cell.astype(np.int32)), pa.array(n)], ["bucket", "cell", "n"])

    for batch in batches:
        for bucket, grams in zip(batch.column(0).to_pylist(), batch.column(1)):
            n = np.bincount(np.frombuffer(grams.as_buffer(), np.int64) & (_CELLS - 1), minlength=_CELLS).astype(np.int64)
            held[bucket] = held[bucket] + n if bucket in held else n
        if len(held) > 2048:
            yield out()
    if held:
        yield out()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, gram, sets) of the shingles in crowded cells."""
    for batch in batches:
        for bucket, grams, cells in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            gram = np.frombuffer(grams.as_buffer(), np.int64)
            gram, n = np.unique(gram[np.isin(gram & (_CELLS - 1), cells)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), bucket, np.int32)), pa.array(gram), pa.array(n.astype(np.int64))], ["bucket", "gram", "sets"])


def _hot_grams(blobs: DataFrame) -> DataFrame:
    """(bucket, hot): shingles that more than three quarters of `_HOT` sets hold, by exact counts over all postings of the
    cells that are crowded enough to hold one, however thinly their sets are spread over batches."""
    most = 0.75 * _HOT
    crowded = blobs.select("bucket", "grams").mapInArrow(_cells, "bucket int, cell int, n long").groupBy("bucket", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    crowded = written(crowded.groupBy("bucket").agg(F.collect_list("cell").alias("cells")), "crowded")  # at most _CELLS a bucket
    counted = blobs.select("bucket", "grams").join(small(crowded, _BROADCAST), "bucket").select("bucket", "grams", "cells").mapInArrow(_counted, "bucket int, gram long, sets long")
    often = counted.groupBy("bucket", "gram").agg(F.sum("sets").alias("sets")).where(F.col("sets") > most)
    return written(often.groupBy("bucket").agg(F.collect_list("gram").alias("hot")), "hot")


def _without_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, grams, keys, hot in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
            gram, key = np.frombuffer(grams.as_buffer(), np.int64), np.frombuffer(keys.as_buffer(), np.int64)
            stay = ~np.isin(gram, hot or [])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([gram[stay].tobytes()], pa.binary()), pa.array([key[stay].tobytes()], pa.binary())], ["bucket", "grams", "keys"])


def _only_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for grams, keys, hot in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
            gram, key = np.frombuffer(grams.as_buffer(), np.int64), np.frombuffer(keys.as_buffer(), np.int64)
            own = np.isin(gram, hot)
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(gram[own])], ["key", "gram"])


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """The postings of one bucket whose shingle is in two distinct sets at least, with the number of sets."""
    gram = np.frombuffer(b"".join(rows["grams"]), np.int64)
    key = np.frombuffer(b"".join(rows["keys"]), np.int64)
    order = np.lexsort((key, gram))
    gram, key = gram[order], key[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
    gram, key = gram[new], key[new]
    _, at, df = np.unique(gram, return_inverse=True, return_counts=True)
    df = df[at]
    keep = df > 1
    return pd.DataFrame({"key": key[keep], "gram": gram[keep], "df": df[keep].astype(np.int64)})


def candidate_regions(texts: DataFrame, k: int, num: int, den: int, postings: int) -> DataFrame:
    """(key, region): classes of equal sets that may have a partner; documents that link are in one region.

    With t = num/den, need(n) = ceil(t n) and l(n) = floor((1 - t) n), two sets that link share l shingles at least in
    their n - need(n) + l(n) smallest hashes. A set with fewer shared ones there has no partner. The others share one at
    least among their rarest count - l + 1 of those (rarity counted over the whole corpus); sets joined by such a
    shingle, and by chains of them, form a region.

    Postings meet in buckets of hashes, but those of a shingle that nearly `_HOT` sets hold or more (see `_hot_grams`) stay rows; such shingles count as equally frequent, which is a rarity that all sets see alike.
    """
    buckets = max(64, -(-postings // _BUCKET))
    blobs = written(texts.select("text").mapInArrow(_postings(k, num, den, buckets), "bucket int, grams binary, keys binary"), "blobs")
    hot = _hot_grams(blobs)
    light = blobs.join(small(hot, _BROADCAST), "bucket", "left").select("bucket", "grams", "keys", "hot").mapInArrow(_without_hot, "bucket int, grams binary, keys binary")
    heavy = blobs.join(small(hot, _BROADCAST), "bucket").select("bucket", "grams", "keys", "hot").mapInArrow(_only_hot, "key long, gram long").distinct()
    shared = light.groupBy("bucket").applyInPandas(_shared, "key long, gram long, df long").unionByName(heavy.withColumn("df", F.lit(1 << 40)))
    size = F.col("key").bitwiseAND(_SIZE)
    least = F.expr(f"cast(ceil((key & {_SIZE}) * {num} / {den}) as long)")
    extra = lambda n: F.greatest(F.lit(1), F.floor(n * (den - num) / den))
    by = Window.partitionBy("key")
    ranked = shared.withColumn("count", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy("df", "gram"))).withColumn("least", F.least(extra(size), extra(least)))
    found = written(ranked.where((F.col("count") >= F.col("least")) & (F.col("rank") <= F.col("count") - F.col("least") + 1)).select("key", "gram"), "postings")
    first = written(found.groupBy("gram").agg(F.min("key").alias("first"), F.count("*").alias("sets")).where("sets > 1").select("gram", "first"), "firsts")
    star = found.join(first, "gram").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b")).distinct()
    return components(star).select(F.col("node").alias("key"), F.col("component").alias("region"))


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            words = Words(batch.column(2))
            sets = [shingles(words.of(i), k).tobytes() for i in range(len(words))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["region", "doc", "grams"])

    return run


class _Sets:
    """Shingle sets with an index from shingle to sets: one probe gives the distances of a set to all others."""

    def __init__(self, blobs, num: int, den: int):
        self.sets = [np.frombuffer(b, np.uint64) for b in blobs]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        flat = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.owner = flat[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        self.num, self.den, self.radius = num, den, 1 - num / den

    def probe(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to all sets, and which of them link (decided in integers)."""
        lo, hi = np.searchsorted(self.grams, s, "left"), np.searchsorted(self.grams, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sets))
        either = self.sizes + len(s) - both
        return 1 - both / np.maximum(either, 1), (self.den * both >= self.num * either) & (both > 0)


class _Forest:
    def __init__(self, labels: np.ndarray):
        _, self.up = np.unique(labels, return_inverse=True)
        self.up = self.up.copy()

    def root(self, i: int) -> int:
        return self.up[i]

    def unite(self, i: int, j: int) -> bool:
        a, b = self.up[i], self.up[j]
        if a == b:
            return False
        self.up[self.up == b] = a
        return True


def _join(index: _Sets, forest: _Forest, members: np.ndarray, out: list[tuple[int, int]]) -> None:
    """Link all pairs of members within the radius, unless links already found connect them."""

    def probe(i: int, among: np.ndarray) -> np.ndarray:
        far, linked = index.probe(index.sets[i])
        for j in among[linked[among]]:
            if forest.unite(i, j):
                out.append((i, j))
        return far[among]

    todo = [members]
    while todo:
        part = todo.pop()
        if len(np.unique(forest.up[part])) == 1:
            continue
        if len(part) <= _LEAF:
            for i in part:
                probe(i, part)
            continue
        pivots, far = [part[0]], [probe(part[0], part)]
        while len(pivots) < _PIVOTS:  # farthest first
            nearest = np.min(far, axis=0)
            if nearest.max() <= 0:
                break
            pivots.append(part[nearest.argmax()])
            far.append(probe(pivots[-1], part))
        far = np.array(far)
        regions = [part[d <= far.min(axis=0) + 2 * index.radius + 1e-9] for d in far]
        homes = [part[far.argmin(axis=0) == j] for j in range(len(far))]
        for home, region in zip(homes, regions):
            if len(region) < 0.7 * len(part):
                todo.append(region)
            else:  # the windows hold nearly all: probe what is not in one component with everything
                for i in home:
                    if (forest.up[region] != forest.up[i]).any():
                        probe(i, region)


def _region(num: int, den: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        index, out = _Sets(rows["grams"], num, den), []
        doc = rows["doc"].to_numpy()
        _join(index, _Forest(np.arange(len(rows))), np.arange(len(rows)), out)
        return pd.DataFrame([(doc[i], doc[j]) for i, j in out], columns=["a", "b"])

    return run


def _to_pivots(num: int, den: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["is_pivot", "doc"], kind="stable")
        home, pivots = rows[~rows["is_pivot"]], rows[rows["is_pivot"]]
        index = _Sets(home["grams"], num, den)
        both = [index.probe(np.frombuffer(g, np.uint64)) for g in pivots["grams"]]
        far = np.ones((len(home), _STAR))
        far[:, : len(both)] = np.array([d for d, _ in both]).T
        linked = np.array([x for _, x in both]).T
        names = pivots["doc"].to_numpy()
        return pd.DataFrame({"region": home["region"], "doc": home["doc"], "grams": home["grams"], "far": list(far), "linked": [names[x] for x in linked]})

    return run


def _visits(num: int, den: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["visits", "doc"], kind="stable")
        home, guests = rows[~rows["visits"]], rows[rows["visits"]]
        if not len(home) or not len(guests):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        index, far = _Sets(home["grams"], num, den), np.stack(home["far"])
        docs, labels = home["doc"].to_numpy(), np.concatenate([home["label"].to_numpy(), guests["label"].to_numpy()])
        forest, out = _Forest(labels), []
        for g, (doc, blob, d) in enumerate(zip(guests["doc"], guests["grams"], guests["far"])):
            me = len(home) + g
            near = (np.abs(far - d).max(axis=1) <= index.radius + 1e-9) & (forest.up[: len(home)] != forest.up[me])
            if near.any():
                _, linked = index.probe(np.frombuffer(blob, np.uint64))
                for j in np.flatnonzero(linked & near):
                    if forest.unite(me, j):
                        out.append((doc, docs[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _dealt(count: str, per: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("doc", F.lit(seed)), F.ceil(F.col(count) / per)).cast("int")


def _large_regions(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links in regions too large for one task.

    Pivots are compared with every document of their region, in chunks. Documents that the largest component of that
    step does not hold then visit the cells around their own; others need no second look, as they are connected already.
    A cell is a step of `radius` in the distance to the first pivot (triangle inequality) and a step of den / num in the
    size of the set (a smaller set cannot share more than it holds), so linked documents are in adjoining cells.
    """
    radius, growth = (1 + 1e-9) * max(1 - num / den, 1e-9), (1 + 1e-9) * max(math.log(den / num), 1e-9)
    size = F.log(F.length("grams") / F.lit(8.0))
    place = F.floor(F.element_at("far", 1) / F.lit(radius)) * _ROW + F.floor(size / F.lit(growth))
    around = F.array(*(F.col("cell") + _ROW * i + j for i in (-1, 0, 1) for j in (-1, 0, 1)))
    slot = F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(_STAR))
    pivots = sets.groupBy("region", slot.alias("slot")).agg(F.min_by("doc", F.xxhash64("doc", F.lit(8))).alias("doc")).select("region", "doc")
    chunks = sets.select("region", "documents").distinct().select("region", F.explode(F.sequence(F.lit(0), F.ceil(F.col("documents") / _CHUNK).cast("int") - 1)).alias("chunk"))
    homes = sets.select("region", _dealt("documents", _CHUNK, 9).alias("chunk"), "doc", "grams", F.lit(False).alias("is_pivot"))
    copies = sets.join(pivots, ["region", "doc"]).join(chunks, "region").select("region", "chunk", "doc", "grams", F.lit(True).alias("is_pivot"))
    compared = homes.unionByName(copies).groupBy("region", "chunk").applyInPandas(_to_pivots(num, den), "region long, doc long, grams binary, far array<double>, linked array<long>")
    compared = written(compared, "compared")
    links = written(compared.select(F.col("doc").alias("a"), F.explode("linked").alias("b")).where("a <> b"), "links")
    labels = components(links).select(F.col("node").alias("doc"), F.col("component").alias("label"))
    labelled = written(compared.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc")).withColumn("cell", place), "labelled")
    main = labelled.groupBy("region", "label").count().groupBy("region").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = labelled.join(main, "region").where("label <> main").select("region", "doc", "grams", "far", "label", "cell")
    rest = written(rest, "visitors").withColumn("cell", F.explode(around))
    cells = labelled.groupBy("region", "cell").agg(F.count("*").alias("homes")).join(rest.groupBy("region", "cell").agg(F.count("*").alias("guests")), ["region", "cell"])
    cells = written(cells, "cells")
    every = lambda n, per: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / per).cast("int") - 1))
    side = lambda df, visits: df.select("region", "cell", "i", "j", "doc", "grams", "far", "label", F.lit(visits).alias("visits"))
    at_home = side(labelled.join(cells, ["region", "cell"]).withColumn("i", _dealt("homes", _BLOCK, 10)).withColumn("j", every("guests", _BLOCK)), False)
    visiting = side(rest.join(cells, ["region", "cell"]).withColumn("j", _dealt("guests", _BLOCK, 11)).withColumn("i", every("homes", _BLOCK)), True)
    found = at_home.unionByName(visiting).groupBy("region", "cell", "i", "j").applyInPandas(_visits(num, den), "a long, b long")
    return links.unionByName(found)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents whose sets have den * intersection >= num * union are linked.

    component_id is the smallest doc_id that links reach; equal sets are always linked, empty ones never.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    classes = written(texts.mapInArrow(_digests(words), "doc_id long, n long, hi long, lo long"), "classes")
    reps = written(classes.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("doc")).withColumn("key", F.col("hi").bitwiseAND(~_SIZE).bitwiseOR(F.least("n", F.lit(_SIZE)))), "reps")
    postings = int((reps.agg(F.sum("n")).first()[0] or 0) * 2 * (den - num) / den)
    regions = candidate_regions(texts, words, num, den, postings)
    wanted = written(reps.join(regions, "key").select("region", "doc").distinct(), "wanted")
    sets = texts.join(small(wanted, _BROADCAST), texts["doc_id"] == wanted["doc"]).select("region", "doc", "text").mapInArrow(_sets(words), "region long, doc long, grams binary")
    sets = written(sets.dropDuplicates(["region", "doc", "grams"]), "sets")
    sizes = written(sets.groupBy("region").agg(F.count("*").alias("documents")), "sizes")
    sets = sets.join(sizes, "region")
    links = sets.where(F.col("documents") <= REGION).select("region", "doc", "grams").groupBy("region").applyInPandas(_region(num, den), "a long, b long")
    if not sizes.where(F.col("documents") > REGION).isEmpty():
        links = links.unionByName(_large_regions(written(sets.where(F.col("documents") > REGION), "large"), num, den))
    joined = components(written(links, "found")).select(F.col("node").alias("doc"), "component")
    named = written(reps.join(joined, "doc", "left").select("n", "hi", "lo", F.coalesce("component", "doc").alias("component")), "named")
    full = classes.where("n > 0").join(named, ["n", "hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return full.unionByName(classes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The documents without near copies: of each component, the rows of the smallest id stay, with all their columns."""
    found = ngram_components(docs, **params)
    id_col = params.get("id_col", "doc_id")
    drop = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "dropped")
    return docs.where(F.col(id_col).isNotNull()).join(small(drop, _BROADCAST), id_col, "left_anti").select(docs.columns)
