"""Maximal periodic runs of words in whole texts, found through Lyndon words, and texts with each run's repeats dropped.

The longest Lyndon word that starts at a word ends where the next smaller suffix starts. A scan from right to left keeps
those suffixes as a linked stack, once under an order of the words and once under its reverse; by the runs theorem the
period of every run is the length of such a Lyndon word under one of the two. Suffixes are compared by their longest common
extension: a few words directly, then by binary search over rolling hashes. Hashes only propose: what they find is
compared word by word (each diagonal remembers the stretch that it has compared, so it is not compared again), and a
stretch that differs after all is measured directly. Words are numbered by a dictionary of the text itself, so equal numbers
are equal words. Each text is one row's work; nothing is shuffled.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; rows without an id are left out;
repeated rows are each returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import mix, slices

#: Words compared directly before hashes are asked.
_DIRECT = 8
_MASK = (1 << 64) - 1
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Extensions:
    """Longest common extensions of the word sequence `codes`, which ends with a sign of its own."""

    def __init__(self, codes: list[int]):
        self.codes, self.n = codes, len(codes) - 1
        self.flat = np.array(codes, np.int64)
        self.sums: list[int] = []
        self.compared: dict[int, tuple[int, int]] = {}  # by distance: a maximal stretch of equal words that was compared

    def _same(self, i: int, j: int, k: int) -> bool:
        """Whether the hashes of the k words from i and from j agree, i < j."""
        if not self.sums:
            powers = np.cumprod(np.full(self.n + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
            self.powers = powers.tolist()
            self.sums = [0, *np.cumsum(mix(self.flat[:-1].astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64).tolist()]
        s = self.sums
        return (s[i + k] - s[i]) * self.powers[j - i - 1] & _MASK == s[j + k] - s[j] & _MASK

    def _proposed(self, most: int, same) -> int:
        low, high = 0, most
        while low < high:
            k = (low + high + 1) // 2
            low, high = (k, high) if same(k) else (low, k - 1)
        return low

    def after(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        c, k, most, p = self.codes, 0, self.n - j, j - i
        if (known := self.compared.get(p)) and known[0] <= i < known[1]:
            return known[1] - i
        while k < most and k < _DIRECT and c[i + k] == c[j + k]:
            k += 1
            if known and i + k == known[0]:  # from there on the stretch is known
                self.compared[p] = i, known[1]
                return known[1] - i
        if k < _DIRECT or k == most:
            return k
        k = self._proposed(most, lambda k: self._same(i, j, k))
        joined = known and i < known[0] <= i + k
        stop = known[0] if joined else i + k
        if not np.array_equal(self.flat[i:stop], self.flat[i + p : stop + p]):
            stop, joined = i + int(np.argmax(self.flat[i:stop] != self.flat[i + p : stop + p])), False
        stop = known[1] if joined else stop
        self.compared[p] = i, stop
        return stop - i

    def before(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        c, k = self.codes, 0
        while k < i and k < _DIRECT and c[i - k - 1] == c[j - k - 1]:
            k += 1
        if k < _DIRECT or k == i:
            return k
        k = self._proposed(i, lambda k: self._same(i - k, j - k, k))
        differ = self.flat[i - k : i] != self.flat[j - k : j]
        return k - 1 - int(np.flatnonzero(differ)[-1]) if differ.any() else k


def lyndon_ends(codes: list[int], same: Extensions) -> list[int]:
    """Where the longest Lyndon word from each word on ends; codes end with a sign below all others."""
    n = len(codes) - 1
    ends = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        x, j = codes[i], i + 1
        while True:
            y = codes[j]
            if x > y:
                break
            if x == y:
                k = same.after(i, j)
                if codes[i + k] > codes[j + k]:
                    break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(words: list[bytes], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least `least` words and `times` (two or more) periods, by start."""
    n, index = len(words), {}
    if n < least:
        return []
    codes = [index.setdefault(w, len(index)) for w in words]
    if n - len(index) < times - 1:  # no word occurs often enough
        return []
    codes.append(-1)
    same, found = Extensions(codes), set()
    top, flat, at = len(index), same.flat, np.arange(n)
    reach: dict[int, int] = {}
    for order in (codes, [top - c for c in codes[:-1]] + [-1]):
        period = np.array(lyndon_ends(order, same)[:n]) - at
        i = at[at + (times - 1) * period <= n]  # the root that starts within a run's first period lies times - 1 whole ones before its end
        p = period[i]
        i = i[(flat[i] == flat[i + (times - 2) * p]) & (flat[i + p - 1] == flat[i + (times - 1) * p - 1])]
        reach.clear()
        for i, p in zip(i.tolist(), period[i].tolist()):
            if i + 2 * p <= reach.get(p, 0):
                continue  # within a run of this period that was measured
            start, end = i - same.before(i, i + p), i + p + same.after(i, i + p)
            reach[p] = end
            if end - start >= max(least, times * p):
                found.add((start, end - start, p))
    return sorted(found)


def kept_of(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(id, runs, collapsed): each whole text's runs as an array of (start, length, period) in that order, and its other words
    joined by one space."""
    ids = pa.int64() if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, 2 << 20)):
            runs, texts = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()  # ASCII white space alone parts bytes
                found = runs_of(words, least, times)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(b" ".join(kept_of(words, found)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(ids), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())], [id_col, "runs", "collapsed"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long" if ids == pa.int64() else "string"), F.col(text_col).cast("string").alias("text"))
    kind = "long" if ids == pa.int64() else "string"
    return rows.mapInArrow(run, f"`{id_col}` {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted(id_col: str, text_col: str) -> Column:
    """The text, with every tenth document (by the checksum of its id) turned periodic from a place of its own on: what a
    search for runs can be measured by, as real ones are rare."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)

    def turned(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        later = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a.cast("int")), later), " "))

    # the words are bound once as a variable: as an expression they would be split anew for each word
    return F.when(h % 10 == 0, F.transform(F.array(words), turned)[0]).otherwise(F.col(text_col))
