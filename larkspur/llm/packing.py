"""Best-fit packing of tokenised documents with certified bin counts.

Pieces are dealt to partitions by hash and packed by best-fit decreasing. A lower bound from dual-feasible functions over
the partition's length histogram certifies its bin count: where bins and bound agree, nothing can be gained. Partitions
with a gap keep their exactly full bins, exchange the documents of the others (dealt anew over fewer partitions) and rerun
best-fit decreasing, as long as that lowers the count; `certificate` compares the whole result with the bound of all pieces. Only lengths and row numbers travel with a partition; token ids
stay with the tokenised table and can be joined by piece.

Defined cases: a null or empty text is the end id alone; a null id packs like any other; repeated rows are packed each;
an empty table gives an empty result. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Words, alike, hashed, held, lowered, slices, written

#: Pieces of one packing partition, bytes of text tokenised at once, and ids and bytes that a worker remembers.
_PART = 4096
_TEXTS = 2 << 20
_MEMO = 8 << 20
#: Words joined into one text for the tokenizer, and characters encoded at once.
_JOINED, _ENCODED = 4096, 64 << 10
#: Signs that may stand behind the letters of a word without changing how those are split; letters; the second bytes of
#: those letters whose first byte is C3 (all but the signs for multiplication and division).
_SIGN, _LETTER, _ACCENTED = (np.zeros(256, bool) for _ in range(3))
_SIGN[list(b".,;:!?")] = True
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_ACCENTED[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


class _Memo:
    """Token ids of parts of words (runs without ASCII white space, which the tokenizer splits at in any case).

    Most words are letters with signs behind: the tokenizer splits before the signs and lowers letters itself, so letters
    and signs are parts of their own that many words share; other words are one part. Parts that are not known yet are
    encoded, letters many at a time and parted at end-of-word tokens. Parts are found by hash and then compared by bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.size, self.at = np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
        self.ids, self.spelled = np.empty(0, np.uint32), np.empty(0, np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        """In parts of bounded size, as an encoding holds far more than its ids."""
        out, a, n = [], 0, 0
        for b, text in enumerate(texts, 1):
            n += len(text) + 16
            if n > _ENCODED or b == len(texts):
                out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
                a, n = b, 0
        return out

    def letters(self, new: list[bytes]) -> list[bytes]:
        """The ids of runs of letters."""
        out = []
        for a in range(0, len(new), _JOINED):
            part = new[a : a + _JOINED]
            ids = np.frombuffer(self.encode([b" ".join(part).decode()])[0], np.uint32)
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) == len(part):
                blob, at = ids.tobytes(), [0, *(4 * end).tolist()]
                out += [blob[i:j] for i, j in zip(at, at[1:])]
            else:
                out += self.encode([w.decode() for w in part])
        return out

    def learn(self, keys: np.ndarray, parts: list[bytes], plain: np.ndarray) -> None:
        ids = np.empty(len(parts), object)
        ids[plain] = self.letters([parts[i] for i in np.flatnonzero(plain)])
        ids[~plain] = self.encode([parts[i].decode() for i in np.flatnonzero(~plain)])
        n, size = (np.fromiter(map(len, x), np.int64, len(parts)) for x in (ids, parts))
        begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(n // 4) - n // 4])
        at = np.concatenate([self.at, len(self.spelled) + np.cumsum(size) - size])
        keys, n = np.concatenate([self.keys, keys]), np.concatenate([self.size, n // 4])
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.at, self.size = keys[order], begin[order], at[order], n[order]
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), np.uint32)])
        self.spelled = np.concatenate([self.spelled, lowered(np.frombuffer(b"".join(parts), np.uint8))])

    def texts(self, column: pa.Array) -> list[bytes]:
        """The ids of each text, from those of its parts."""
        words = Words(column)
        raw, start, end, bounds = words.raw, words.start, words.end, words.bounds
        data = raw.tobytes()
        if b"<|" in data:  # signs of special tokens keep their case
            return self.encode([t or "" for t in column.to_pylist()])
        core, plain = _cores(raw, start, end)
        tail = plain & (core < end)
        n = 1 + tail.astype(np.int64)
        first = np.cumsum(n) - n
        start, end, letters = np.repeat(start, n), np.repeat(np.where(plain, core, end), n), np.repeat(plain, n)
        start[first[tail] + 1], end[first[tail] + 1], letters[first[tail] + 1] = core[tail], words.end[tail], False
        bounds = np.concatenate([first, [n.sum()]])[bounds]
        hashes = hashed(raw, start, end)
        keys, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        at, known = held(self.keys, keys)
        if not known.all():
            if len(self.ids) + len(self.spelled) > _MEMO:
                self.forget()
                known[:] = False
            new = one[~known]
            self.learn(keys[~known], [data[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())], letters[new])
            at, _ = held(self.keys, keys)
        at = at[back]
        if not alike(raw, start, end, self.spelled, self.at[at]):  # two parts of one hash
            return self.encode([t or "" for t in column.to_pylist()])
        n = self.size[at]
        to = np.concatenate([[0], np.cumsum(n)])
        stream = self.ids[np.repeat(self.begin[at] - to[:-1], n) + np.arange(to[-1])].tobytes()
        cuts = (4 * to[bounds]).tolist()
        return [stream[a:b] for a, b in zip(cuts, cuts[1:])]


def _cores(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the signs at each word's end begin, and whether only letters (ASCII, or of the two bytes C3 xx) stand before."""
    if not len(start):
        return start, np.zeros(0, bool)
    last = np.maximum.accumulate(np.where(_SIGN[raw], -1, np.arange(len(raw))))
    core = np.maximum(last[end - 1] + 1, start)
    lead = raw == 0xC3
    good = np.zeros(len(raw), bool)
    good[:-1] = lead[:-1] & _ACCENTED[raw[1:]]
    second = np.zeros(len(raw), bool)
    second[1:] = good[:-1]
    other = np.concatenate([[0], np.cumsum(~(_LETTER[raw] | good | second))])
    return core, (core > start) & (other[core] == other[start])


def _tokenise(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last = _Memo(path), np.array([end], "<u4").tobytes()
        for big in batches:
            for batch in slices(big, 1, _TEXTS):
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), memo.texts(batch.column(1))):
                    ids += last
                    rows += [(doc, k, a // 4, ids[a : a + 4 * capacity]) for k, a in enumerate(range(0, len(ids), 4 * capacity))]
                doc, piece, start, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return run


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): token ids (little-endian 32-bit) with the end id, cut at `capacity`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_tokenise(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids binary")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of(lengths, np.ones(len(lengths), np.int64), capacity)


def bound_of(lengths: np.ndarray, times: np.ndarray, capacity: int) -> int:
    """The best of the bounds of two families of dual-feasible functions, over the histogram of lengths."""
    if not len(lengths):
        return 0
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, lengths, times)
    size = np.arange(capacity + 1)
    n, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    e = np.arange(capacity // 2 + 1)  # lengths over capacity - e count as a bin, those under e as nothing
    best = int((((n[-1] - n[capacity - e + 1]) * capacity + s[capacity - e + 1] - s[e] + capacity - 1) // capacity).max())
    for k in range(1, 21):
        whole = (k + 1) * size % capacity == 0
        scaled = np.where(whole, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length; of bins with room the fullest, of equals the one that reached that room last."""
    order = np.argsort(-lengths, kind="stable")
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, filled, n = np.empty(len(lengths), np.int64), 0, 0
    for i in order.tolist():
        size = int(lengths[i])
        open_ = filled >> size
        if open_:
            room = size + (open_ & -open_).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                filled ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        if left := room - size:
            rooms[left].append(b)
            filled |= 1 << left
    return bins


def _packed(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", kind="stable")
        length = rows["length"].to_numpy()
        bins = best_fit_decreasing(length, capacity)
        used = np.bincount(bins, weights=length).astype(np.int64)
        order = np.lexsort((rows["row"].to_numpy(), bins))
        sums = np.cumsum(length[order]) - length[order]
        offset = np.empty(len(rows), np.int64)
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset[order] = sums - np.maximum.accumulate(np.where(first, sums, 0))
        return pd.DataFrame({"row": rows["row"], "length": length, "part": rows["part"], "bin": bins, "offset": offset, "full": used[bins] == capacity, "bins": len(used), "bound": lower_bound(length, capacity)})

    return run


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (with a column `length` of at most capacity) with `sequence_id` and `offset`; other columns stay.

    A column of either name gives way to the result's. Partitions exchange until a round no longer lowers the count.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = written(pieces.select(*kept, F.monotonically_increasing_id().alias("row__")), "pieces")
    schema = "row long, length long, part int, bin long, offset long, full boolean, bins int, bound int"
    short = rows.where(F.col("length") < capacity).select(F.col("row__").alias("row"), "length")
    number = lambda r: (F.lit(r << 56) + F.col("part").cast("long") * (1 << 24) + F.col("bin")).alias("sequence_id")
    placed = [rows.where(F.col("length") == capacity).select(F.col("row__").alias("row"), (F.lit(127 << 56) + F.col("row__")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    loose, best, r = short, None, 0
    while n := loose.count():
        parts = -(-n // _PART)
        deal = F.pmod(F.xxhash64("row", F.lit(100 + r)), F.lit(parts)).cast("int").alias("part")
        now = written(loose.select("row", "length", deal).groupBy("part").applyInPandas(_packed(capacity), schema), "packed")
        open_ = (F.col("bins") > F.col("bound")) & ~F.col("full")
        made, left = now.groupBy("part", "bin").agg(F.first(open_).alias("open")).agg(F.count("*"), F.count_if("open")).first()
        if best is not None and made >= best[0]:
            break
        if best is not None:
            placed[-1] = best[1]  # the bins that stay closed; the loose ones are packed anew
        loose = now.where(open_).select("row", "length")
        best = (left, now.where(~open_).select("row", number(r), "offset"))
        placed.append(now.select("row", number(r), "offset"))
        r += 1
        if parts == 1:
            break
    found = placed[0]
    for p in placed[1:]:
        found = found.unionByName(p)
    return rows.join(found.withColumnRenamed("row", "row__"), "row__").drop("row__")


def certificate(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row (bins, bound): the sequences used, and how few the dual-feasible functions prove possible for all pieces."""

    def bounded(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bins": [int(rows["bins"].iloc[0])], "bound": [bound_of(rows["length"].to_numpy(), rows["n"].to_numpy(), capacity)]})

    lengths = packed.groupBy("length").agg(F.count("*").alias("n"))  # a row a length, capacity rows at most
    bins = packed.agg(F.count_distinct("sequence_id").alias("bins"))
    return lengths.crossJoin(F.broadcast(bins)).groupBy("bins").applyInPandas(bounded, "bins long, bound long")
