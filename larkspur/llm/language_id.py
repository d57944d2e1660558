"""The language of whole texts by cross-parsing: how few longest matches with a language's labelled text spell a text out.

Each language has the suffix automaton of a sample of its labelled texts, which knows every substring of it. A text is
parsed from left to right into phrases, each the longest match that the automaton can follow (a byte it does not know is a
phrase of its own); phrases times the bits that name a place in the sample, per byte, estimate the cross entropy. The
language that needs the least wins. Texts are lower-cased and ASCII signs, digits and white space become single spaces.

The automata are fitted on a bounded sample: pieces of the labelled training texts, chosen by hash over all of them,
`SAMPLE` bytes a language and `TOTAL` bytes over all languages. All other work covers whole texts: they are cut into
stretches of `STRETCH` bytes, each of which starts a new phrase, and the stretches of a batch walk through the automata in
step, a table lookup for each byte and language.

Defined cases: a null text or one without any letter is `und` with score 0, as is every text where nothing was learned;
ties go to the smallest language in code-point order; rows without an id are left out; repeated rows are each judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import slices, small, written

#: Bytes of labelled text a language's automaton is built from, and over all languages: the bounds of the fitted sample.
SAMPLE, TOTAL = 1 << 15, 1 << 18
#: Code points of a sampled piece; bytes of a stretch that is parsed on its own.
PIECE, STRETCH = 512, 1024
_SEED = 11
_SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """A text as it is parsed; a space at either end marks where its first and last words end."""
    return b" ".join([b"", *text.lower().encode().translate(_SPACED).split(), b""])


def automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a text, by state; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for byte in text:
        new, state = len(moves), last
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        while state >= 0 and byte not in moves[state]:
            moves[state][byte] = new
            state = link[state]
        if state >= 0:
            there = moves[state][byte]
            if length[there] > length[state] + 1:  # it also ends longer substrings: part them
                copy = len(moves)
                moves.append(dict(moves[there]))
                link.append(link[there])
                length.append(length[state] + 1)
                link[there] = copy
                while state >= 0 and moves[state].get(byte) == there:
                    moves[state][byte] = copy
                    state = link[state]
                there = copy
            link[new] = there
        last = new
    return moves


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of a language: its automaton's transitions as sorted arrays."""
    text = b" ".join(plain(x) for x in rows.sort_values(["h", "piece"])["piece"])
    moves = automaton(text)
    flat = np.array([(s, b, t) for s, out in enumerate(moves) for b, t in out.items()], np.int32).reshape(-1, 3)
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "n_bytes": [len(text)], "states": [len(moves)], "moves": [flat.tobytes()]})


def learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, total: int = TOTAL) -> DataFrame:
    """(lang, n_bytes, states, moves) for each language of `docs`; rows with a null language or text teach nothing."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = written(rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")), "sizes")
    each = max(PIECE, min(sample, total // max(1, sizes.count())))
    share = sizes.select("lang", F.least(F.lit(1.0), (2 * each + 64 * PIECE) / F.col("chars")).alias("share"))
    h = lambda i: F.xxhash64("text", i, F.lit(_SEED)) / F.lit(2.0**64) + F.lit(0.5)
    starts = F.filter(F.sequence(F.lit(0), F.length("text"), F.lit(PIECE)), lambda i: h(i) < F.col("share"))
    pieces = rows.join(small(share, 100_000), "lang").select("lang", "text", F.explode(starts).alias("i")).select("lang", h(F.col("i")).alias("h"), F.substring("text", F.col("i") + 1, PIECE).alias("piece"))
    before = F.sum(F.octet_length("piece") + 1).over(Window.partitionBy("lang").orderBy("h", "piece").rowsBetween(Window.unboundedPreceding, -1))
    chosen = pieces.where("piece <> ''").distinct().withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + F.octet_length("piece") <= each + PIECE)
    return written(chosen.groupBy("lang").applyInPandas(_built, "lang string, n_bytes long, states long, moves binary"), "automata").where("n_bytes > 0")


class Parsers:
    """The automata of all languages as tables of next states by byte; a set low bit says that a phrase begins."""

    def __init__(self, model: list[tuple[str, int, int, bytes]]):
        model = sorted(model)
        self.langs, self.bits = [m[0] for m in model], np.array([np.log2(m[1] + 1) for m in model])
        self.moves = [(m[2], np.frombuffer(m[3], np.int32).reshape(-1, 3)) for m in model]
        self.tables: list[np.ndarray] = []

    def _open(self) -> None:
        """Tables are laid out where they are used: they are larger than what is broadcast."""
        known = np.unique(np.concatenate([m[:, 1] for _, m in self.moves]))
        self.kinds = np.zeros(256, np.uint8)
        self.width = len(known) + 1 if len(known) < 256 else 256
        self.kinds[known] = np.arange(self.width - len(known), self.width)
        for states, moves in self.moves:
            kind = self.kinds[moves[:, 1]]
            root = np.full(self.width, states * self.width * 2 + 1, np.int32)  # the last row: a phrase has just ended
            first = moves[:, 0] == 0
            root[kind[first]] = moves[first, 2] * self.width * 2 + 1
            table = np.tile(root, (states + 1, 1))
            table[moves[:, 0], kind] = moves[:, 2] * self.width * 2
            self.tables.append(table.ravel())

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """How many phrases each text takes, by language."""
        if not self.tables:
            self._open()
        size = np.array([len(t) for t in texts], np.int64)
        pieces = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        length = np.minimum(size[owner] - start, STRETCH)
        at = start + np.repeat(np.cumsum(size) - size, pieces)
        order = np.argsort(-length, kind="stable")
        owner, length, at = owner[order], length[order], at[order]
        flat = self.kinds[np.frombuffer(b"".join(texts), np.uint8)]
        counts = np.zeros((len(self.langs), len(owner)), np.int32)
        states = [np.full(len(owner), (len(t) // self.width - 1) * self.width, np.int32) for t in self.tables]
        active = np.searchsorted(-length, -np.arange(STRETCH), "left")
        for t in range(int(length.max(initial=0))):
            m = active[t]
            kind = flat[at[:m] + t]
            for k, table in enumerate(self.tables):
                value = table[states[k][:m] + kind]
                counts[k, :m] += value & 1
                states[k][:m] = value >> 1
        return np.array([np.bincount(owner, weights=c, minlength=len(texts)) for c in counts])


def predicted(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits): the language of each whole text, the share of the runner-up's bits in both (0.5: a tie;
    1: no other language) and the winner's bits a byte."""
    parsers = Parsers([tuple(r) for r in model.select("lang", "n_bytes", "states", "moves").collect()])  # bounded by TOTAL
    shared = docs.sparkSession.sparkContext.broadcast(parsers)
    names = [id_col, "lang_pred", "score", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in (part for whole in batches for part in slices(whole, 1, 4 << 20)):
            raw = batch.column(1).to_pylist()
            which = [i for i, t in enumerate(raw) if t and p.langs and any(map(str.isalpha, t))]
            lang, score, bits = np.full(len(raw), "und", object), np.zeros(len(raw)), np.full(len(raw), np.nan)
            if which:
                texts = [plain(raw[i]) for i in which]
                rate = p.phrases(texts) * p.bits[:, None] / np.array([len(t) for t in texts])
                best = rate.argmin(axis=0)
                least = rate.min(axis=0)
                rate[best, np.arange(len(which))] = np.inf
                second = rate.min(axis=0)
                lang[which], bits[which] = np.array(p.langs, object)[best], least
                score[which] = np.where(np.isinf(second), 1.0, second / (least + np.where(np.isinf(second), 0.0, second)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits, from_pandas=True)], names)

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias(id_col), F.col(text_col).cast("string").alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(run, f"`{id_col}` string, lang_pred string, score double, bits double").withColumn(id_col, F.col(id_col).cast(kind))
