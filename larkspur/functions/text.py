"""Text functions as columns of built-in expressions, and Arrow UDFs where none expresses them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Parts words: runs of other characters than letters and digits.
WORD_GAP = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Parts after `.`, `!` or `?` and white space."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 10)


@F.pandas_udf(StringType())
def strip_accents(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def normalized_name(name: Column) -> Column:
    """Lower case without accents, `last, first` turned round, punctuation as single spaces."""
    plain = strip_accents(F.lower(name))
    turned = F.regexp_replace(plain, r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$", "$2 $1")
    return F.trim(F.regexp_replace(turned, r"[^\p{L}\p{N}]+", " "))


def name_variants(name: Column) -> Column:
    """The lower-cased name, its two orders around a comma or the last space, and it without a middle initial."""
    low = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    comma = F.when(low.contains(","), F.regexp_replace(low, r"^([^,]+?)\s*,\s*(.+)$", "$2 $1"))
    turned = F.when(~low.contains(",") & low.contains(" "), F.regexp_replace(low, r"^(.*) (\S+)$", "$2, $1"))
    initial = F.when(low.rlike(r"^\S+ \p{L}\.? \S+$"), F.regexp_replace(low, r"^(\S+) \p{L}\.? (\S+)$", "$1 $2"))
    return F.array_distinct(F.array_compact(F.array(low, comma, turned, initial)))


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, one bit a character of a."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths; two empty texts are equal."""
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


def partial_ratio(needle: str, hay: str) -> float:
    """The best ratio of the shorter text with any window of its length in the longer one, edges included."""
    if len(needle) > len(hay):
        needle, hay = hay, needle
    if not needle or needle in hay:
        return 100.0 if needle or not hay else 0.0
    n, letters = len(needle), set(needle)
    best = 0.0
    for end in range(1, len(hay) + n):
        window = hay[max(0, end - n) : end]
        if (hay[end - 1] if end <= len(hay) else window[0]) in letters:
            best = max(best, ratio(needle, window))
    return best


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _slots(codes: np.ndarray) -> np.ndarray:
    """A number under 2^16 for each two successive characters; beyond Latin-1 some pairs share one."""
    return (codes[:-1] << 8 ^ codes[:-1] >> 8 ^ codes[1:]) & 0xFFFF


def _commons(masks: np.ndarray, n: np.ndarray, width: np.ndarray, which: np.ndarray, start: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Common subsequences of windows (start, width in letters) with their needle of n, one bit a character as in `_common`.

    masks (words of 64 bits, needles, letters) has the places of each letter in each needle; the last letter is in none.
    """
    rows, none = [np.full(len(which), 2**64 - 1, dtype=np.uint64) for _ in masks], masks.shape[2] - 1
    for step in range(int(width.max())):
        letter = np.where(step < width, letters.take(start + step, mode="clip"), none)
        rows = _stepped(rows, [mask[which, letter] for mask in masks])
    return _counted(rows, _filled(n, len(rows)))


def _stepped(rows: list[np.ndarray], found: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of common subsequences after one more letter, which stands at the places `found`."""
    carry, out = None, []
    for row, at in zip(rows, found):
        part = row + (row & at)
        whole = part if carry is None else part + carry
        if len(rows) > 1:
            carry = ((part < row) | (whole < part)).astype(np.uint64)
        out.append(whole | row & ~at)
    return out


def _filled(width: np.ndarray, words: int) -> list[np.ndarray]:
    """The lowest `width` bits, as words of 64."""
    used = [np.minimum(np.maximum(width - 64 * k, 0), 64) for k in range(words)]
    return [np.where(u == 64, np.uint64(2**64 - 1), (np.uint64(1) << (u % 64).astype(np.uint64)) - np.uint64(1)) for u in used]


def _counted(rows: list[np.ndarray], full: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count(~r & f).astype(np.int32) for r, f in zip(rows, full))


class _Needles:
    """Needles of like length (none of under 2 characters) that are looked for together.

    A window of w characters that scores f with a needle of n has a common subsequence of L >= f (n + w) / 2 with it, so it
    lacks n - L of the needle's characters and adds w - L. Each of these parts at most one more pair of neighbours, so at
    least 3 L - n - w - 1 of the window's pairs stand in the needle, each at most n - L places from where it stands in a
    window of n. Windows are cut into steps, and the pairs of a step are looked up among those of the needle's places near
    it. Windows with enough of them, which are all that can score f, are scored where the text of up to a step of such windows
    has a common subsequence of L with the needle. Windows cut by an end of the text are all scored.
    """

    def __init__(self, needles: list[str], floor: float, lanes: int):
        self.floor, self.lanes, codes = floor, lanes, [_codes(n) for n in needles]
        self.n = n = np.array([len(c) for c in codes])
        alphabet = np.unique(np.concatenate(codes))
        self.letter = np.full(0x110000, len(alphabet), dtype=np.int32)
        self.letter[alphabet] = np.arange(len(alphabet))
        self.masks = np.zeros((-(-n.max() // 64), len(n), len(alphabet) + 1), dtype=np.uint64)
        for row, c in enumerate(codes):
            for i, at in enumerate(self.letter[c].tolist()):
                self.masks[i // 64, row, at] |= np.uint64(1 << i % 64)
        self.ahead = [np.ascontiguousarray(m.T) for m in self.masks]
        back = np.zeros_like(self.masks)
        for row, c in enumerate(codes):
            for i, at in enumerate(self.letter[c[::-1]].tolist()):
                back[i // 64, row, at] |= np.uint64(1 << i % 64)
        self.back = [np.ascontiguousarray(m.T) for m in back]

        self.least = least = self._least(n)
        self.step = 1 << min(3, max(0, int(n.max() - 1).bit_length() - 3))
        slots = [_slots(c) for c in codes]
        known = np.unique(np.concatenate(slots))
        self.slot = np.full(1 << 16, len(known), dtype=np.int32)
        self.slot[known] = np.arange(len(known))
        small = np.uint8 if n.max() < 250 else np.uint16
        self.tables = np.zeros((-(-(n.max() - 1) // self.step), len(known) + 1, len(n)), dtype=small)
        for row, s in enumerate(slots):
            at, last, off = self.slot[s], len(s) - 1, n[row] - least[row]
            for k in range(-(-len(s) // self.step)):
                self.tables[k, at[max(0, last - (k + 1) * self.step + 1 - off) : last - k * self.step + off + 1], row] = 1
        self.enough = np.maximum(3 * least - 2 * n - 1, 0).astype(small)

    def _least(self, width: np.ndarray) -> np.ndarray:
        return np.ceil(self.floor * (self.n + width) / 200 - 1e-9).astype(np.int64)

    def matches(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(needles, texts, scores) of windows that reach the floor, in texts (first, size in codes) no shorter than the needle."""
        letters = self.letter[codes]
        for which, start in self._near(codes):
            text = np.searchsorted(first, start, "right") - 1
            inside = (start >= 0) & (start + self.n[which] <= first[text] + size[text])
            which, start, text = which[inside], start[inside], text[inside]
            row, cell = np.unique(which * len(codes) + start // self.step, return_inverse=True)
            row, at = np.divmod(row, len(codes))
            whole = self._common(row, at * self.step, self.step - 1, letters) >= self.least[row]
            which, start, text = (x[whole[cell]] for x in (which, start, text))
            score = 200.0 * self._common(which, start, 0, letters) / (2 * self.n[which])
            good = score >= self.floor
            yield which[good], text[good], score[good]
        yield from self._cut(letters, first, size)

    def _common(self, which: np.ndarray, start: np.ndarray, more: int, letters: np.ndarray) -> np.ndarray:
        """Common subsequences of needles with windows that are so many letters longer."""
        part = [slice(i, i + self.lanes) for i in range(0, len(which), self.lanes)]
        return np.concatenate([np.zeros(0, dtype=np.int32), *(_commons(self.masks, self.n[which[p]], self.n[which[p]] + more, which[p], start[p], letters) for p in part)])

    def _near(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(needles, starts) of windows with enough pairs; some may lie across texts."""
        reach, none, wide = len(self.tables) * self.step - 1, self.tables.shape[1] - 1, max(256, (1 << 18) // len(self.n))
        found, held = [], 0
        for low in range(0, len(codes) - 1, wide):  # windows whose last pair is one of `wide` from here
            part = self.slot[_slots(codes[max(0, low - reach) : low + wide + 1])]
            part = np.concatenate((np.full(max(0, reach - low), none), part))
            count = len(part) - reach + self.step - 1
            total = self.tables[0].take(part[-count:], axis=0)
            for k in range(1, len(self.tables)):
                stop = len(part) - k * self.step
                total += self.tables[k].take(part[stop - count : stop], axis=0)
            span = 1
            while span < self.step:
                total, span = total[span:] + total[:-span], 2 * span
            enough = total >= self.enough
            some = np.flatnonzero(enough.any(axis=1))
            last, which = np.nonzero(enough[some])
            found.append((which, some[last] + low + 2 - self.n[which]))
            held += len(which)
            if held >= self.lanes or low + wide >= len(codes) - 1:
                yield tuple(map(np.concatenate, zip(*found)))
                found, held = [], 0

    def _cut(self, letters: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows of fewer letters than the needle, at the starts and ends of texts."""
        texts = np.flatnonzero(size >= self.n.min())
        full, per = _filled(self.n, len(self.masks)), max(1, self.lanes // len(self.n))
        need = [np.where((least := self._least(np.int64(w))) <= min(w, self.n.max()), least, 1 << 30) for w in range(int(self.n.max()))]
        need = [np.where(w < self.n, x, 1 << 30) for w, x in enumerate(need)]
        for side, masks in ((1, self.ahead), (-1, self.back)):
            for i in range(0, len(texts), per):
                text = texts[i : i + per]
                at = first[text] if side == 1 else first[text] + size[text] - 1
                rows = [np.full((len(text), len(self.n)), 2**64 - 1, dtype=np.uint64) for _ in masks]
                for w in range(1, int(self.n.max())):
                    letter = letters.take(at + side * (w - 1), mode="clip")
                    rows = _stepped(rows, [m.take(letter, axis=0) for m in masks])
                    if need[w].min() <= w:
                        common = _counted(rows, full)
                        row, which = np.nonzero(common >= need[w])
                        kept = self.n[which] <= size[text[row]]
                        row, which = row[kept], which[kept]
                        score = 200.0 * common[row, which] / (self.n[which] + w)
                        good = score >= self.floor
                        yield which[good], text[row[good]], score[good]


#: Needles that are looked for together, in tables of some MB.
_TOGETHER = 256


class Closeness:
    """Needles to find in many texts by their partial ratio, where it is at least `floor`, which must exceed 200 / 3."""

    def __init__(self, needles: list[str], floor: float, lanes: int = 32_768):
        self.needles, self.floor, self.lanes, groups = needles, floor, lanes, {}
        for place, needle in enumerate(needles):
            if len(needle) > 1:
                groups.setdefault(max(5, (len(needle) - 1).bit_length()), []).append(place)
        parts = [g[i : i + _TOGETHER] for g in groups.values() for i in range(0, len(g), _TOGETHER)]
        self.groups = [(np.array(g), _Needles([needles[p] for p in g], floor, lanes)) for g in parts]

    def pairs(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(needles, texts, scores) by place, the best of each pair among them, for needles no longer than the text."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        first, codes = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64), _codes("".join(texts))
        for places, group in self.groups:
            if len(codes) >= group.n.min():
                for which, text, score in group.matches(codes, first, size):
                    yield places[which], text, score
        for place, needle in enumerate(self.needles):
            if len(needle) < 2:
                held = np.array([i for i, t in enumerate(texts) if (needle in t if needle else not t)], dtype=np.int64)
                yield np.full(len(held), place), held, np.full(len(held), 100.0)

    def best(self, texts: list[str]) -> dict[int, float]:
        """The best partial ratio of each needle (by place) in any of the texts; the shorter of the two is the one that is found."""
        out = np.zeros(len(self.needles))
        for which, _, score in self.pairs(texts):
            np.maximum.at(out, which, score)
        most = max(map(len, self.needles), default=0)
        short = sorted({t for t in texts if 0 < len(t) < most})
        for i in range(0, len(short), 512):
            for _, which, score in Closeness(short[i : i + 512], self.floor, self.lanes).pairs(self.needles):
                np.maximum.at(out, which, score)
        return {i: float(out[i]) for i in np.flatnonzero(out >= self.floor).tolist()}


def close_ratios(needles: list[str], hay: str, floor: float, lanes: int = 32_768) -> dict[int, float]:
    """The needles (by place) whose partial ratio with a text is at least `floor`, which must exceed 200 / 3."""
    return Closeness(needles, floor, lanes).best([hay])


def token_set_ratio(a: str, b: str) -> float:
    """Of the shared words, and the shared words with either rest, the best ratio of two."""
    x, y = (set(re.findall(r"\w+", s.lower())) for s in (a, b))
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 100.0
    return max(ratio(both, one) if both else 0.0, ratio(both, two) if both else 0.0, ratio(one, two))


def _pairwise(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


ratio_udf = _pairwise(ratio)
partial_ratio_udf = _pairwise(partial_ratio)
token_set_ratio_udf = _pairwise(token_set_ratio)


def _folded(parts: Column, fits) -> Column:
    """Strings joined by a space to the one before while `fits(last, next)`; one pass, and the array grows by whole results only."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def merge(held: Column, part: Column) -> Column:
        same = held["last"].isNotNull() & fits(held["last"], part)
        done = F.when(same | held["last"].isNull(), held["done"]).otherwise(F.array_append(held["done"], held["last"]))
        return F.struct(done.alias("done"), F.when(same, F.concat(held["last"], F.lit(" "), part)).otherwise(part).alias("last"))

    return F.aggregate(parts, empty, merge, lambda held: F.when(held["last"].isNull(), held["done"]).otherwise(F.array_append(held["done"], held["last"])))


def chunks(text: Column, budget: int) -> Column:
    """Array of chunks of at most `budget` estimated tokens: sentences packed in order while their estimate fits, a sentence
    beyond the budget split at white space first (one longer word stays whole). A null or blank text has none."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    words_of = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")
    short = lambda s: F.length(s) < 4 * (budget + 1)
    pieces = lambda s: F.when(short(s), F.array(s)).otherwise(_folded(words_of(s), lambda a, w: F.length(a) + 1 + F.length(w) <= 4 * budget))
    parts = F.filter(F.flatten(F.transform(F.split(plain, r"(?<=[.!?])\s+"), pieces)), lambda x: x != "")
    return _folded(parts, lambda a, x: F.length(a) + 1 + F.length(x) < 4 * (budget + 1))


def _lowered(text: str) -> str:
    """In lower case, as long as the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Glossary:
    """Terms as a trie with failure links: one pass over a text finds all, however many there are."""

    def __init__(self, terms: list[str]):
        self.terms, self.trie = sorted({_lowered(t) for t in terms if t}), None

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(term, start, end) at word bounds, the longest of those that start first, never overlapping."""
        if self.trie is None:  # built once where it is used
            import ahocorasick

            self.trie = ahocorasick.Automaton()
            for t in self.terms:
                self.trie.add_word(t, t)
            self.trie.make_automaton()
        if not self.terms:
            return []
        low, found, at = _lowered(text), [], 0
        is_word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        hits = [(last - len(t) + 1, -last - 1, t) for last, t in self.trie.iter(low)]
        for start, end, t in sorted(h for h in hits if is_word(h[0] - 1) != is_word(h[0]) and is_word(-h[1] - 1) != is_word(-h[1])):
            if start >= at:
                found.append((t, start, -end))
                at = -end
        return found


#: Characters of all terms up to which a glossary is sent to the tasks.
GLOSSARY = 64 << 20


def find_terms(text: Column, terms: list[str]) -> Column:
    """Spans (term, start, end) of glossary terms without regard to case: longest first, at word bounds, never overlapping.

    The glossary is broadcast once, so its size is checked; match a larger one in parts and keep the longest.
    """
    if sum(map(len, terms)) > GLOSSARY:
        raise ValueError(f"a glossary holds at most {GLOSSARY} characters")
    shared = SparkSession.active().sparkContext.broadcast(Glossary(terms))

    @F.pandas_udf("array<struct<term string, start int, end int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"term": x, "start": a, "end": b} for x, a, b in shared.value.spans(t or "")])

    return run(text)


def highlight_terms(text: Column, terms: list[str]) -> Column:
    alternatives = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?i)\b({alternatives})\b", "**$1**")


def truncated(value: Column, most: int = 100) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(value)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def json_kind(value: Column) -> Column:
    """object, array, string, number, boolean or null, by how a JSON text begins; null where there is none."""
    first = F.substring(F.ltrim(value), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(first.rlike(r"[-0-9]"), "number")


def repaired_json(text: Column) -> Column:
    """The outermost braces or brackets of a text (to its end, if they are not closed) with what models often get wrong put
    right: fences and comments, single or curly quotes, bare keys, Python's words for true, false and null, trailing commas, and
    quotes, brackets and braces that are missing at the end. Strings are set aside first and stay as they are."""
    inner = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)([\[{].*)", 1)
    body = F.regexp_replace(inner, "[\u201c\u201d]", '"')
    strings = r'"(?:[^"\\]|\\.)*"'

    def plain(part: Column) -> Column:
        """What stands outside of strings; from a quote that is never closed on it stays."""
        p = F.regexp_extract(part, '^([^"]*)', 1)
        rest = F.substring(part, F.length(p) + 1, F.length(part))
        p = F.regexp_replace(p, r"(?m)//.*$", "")
        p = F.regexp_replace(p, r"'([^']*)'", '"$1"')
        p = F.regexp_replace(p, r"(?<![\p{L}\p{N}_\"])(?!(?:true|false|null|True|False|None)\b)([A-Za-z_]\w*)(?=\s*:)", '"$1"')
        for python, word in (("True", "true"), ("False", "false"), ("None", "null")):
            p = F.regexp_replace(p, rf"\b{python}\b", word)
        return F.concat(p, rest)

    def joined(parts: Column, kept: Column, last: Column) -> Column:
        """Parts and strings up to the last closing sign outside of strings: what follows it is not part of the value."""
        cut = lambda p, i: F.when((last < 0) | (i < last), plain(p)).when(i == last, plain(F.regexp_extract(p, r'(?s)^([^"]*[\]}])', 1))).otherwise("")
        ended = lambda k, i: F.when((last < 0) | (i < last), k).otherwise("")
        return F.array_join(F.flatten(F.zip_with(F.transform(parts, cut), F.transform(kept, ended), lambda p, k: F.array(p, F.coalesce(k, F.lit(""))))), "")

    def mend(x: Column) -> Column:
        last = lambda parts: F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), F.lit(-1), lambda held, i: F.when(F.get(parts, i).rlike(r'^[^"]*[\]}]'), i).otherwise(held))
        whole = _let(F.split(x, strings, -1), lambda parts: _let(F.regexp_extract_all(x, F.lit(f"({strings})"), F.lit(1)), lambda kept: _let(last(parts), lambda n: joined(parts, kept, n))))
        odd = lambda j: (F.length(j) - F.length(F.replace(j, F.lit('"'), F.lit("")))) % 2 == 1
        return _let(whole, lambda j: F.regexp_replace(F.when(odd(j), F.concat(j, F.lit('"'))).otherwise(j), r",\s*$", ""))

    def balanced(x: Column) -> Column:
        bare = F.regexp_replace(x, strings, "")
        signs = F.filter(F.split(bare, ""), lambda c: c.isin("{", "}", "[", "]"))
        open_ = F.aggregate(signs, F.array().cast("array<string>"), lambda held, c: F.when(c.isin("{", "["), F.array_append(held, c)).otherwise(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))))
        return F.concat(x, F.array_join(F.reverse(F.transform(open_, lambda c: F.when(c == "{", "}").otherwise("]"))), ""))

    mended = _let(body, lambda x: F.regexp_replace(_let(mend(x), balanced), r",\s*([}\]])", "$1"))
    return F.when(body != "", mended)


def parsed_json(text: Column, schema: str) -> Column:
    """The struct in a text: as it is, else its outermost braces, else these repaired; null if none parses."""
    inner = F.regexp_replace(F.regexp_extract(text, r"(?s)(\{.*\})", 1), r",\s*([}\]])", "$1")
    strict = {"mode": "PERMISSIVE"}
    read = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), F.from_json(x, schema, strict))
    return F.coalesce(read(text), read(inner), _let(repaired_json(F.regexp_extract(text, r"(?s)(\{.*)", 1)), read))


#: Fixed value: a header line such as `**4.1 Design basis**`; groups are its number and its title.
SECTION_HEADER = r"\*\*(\d+(?:\.\d+)*\.?)\s+([A-Z0-9][^\n*]+?)\s*\*\*[ \t]*$"


def sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, title, start, length, content): a text cut before each header line; start counts characters from 0.

    What precedes the first header is left out. A text without headers is one section without a number, titled by itself; a
    null text has none.
    """
    parts = F.split(F.col(text), f"(?md)^(?={SECTION_HEADER})", -1)
    starts = F.aggregate(parts, F.array(F.lit(0)), lambda at, p: F.array_append(at, F.element_at(at, -1) + F.length(p)))
    cut = rows.where(F.col(text).isNotNull()).select(F.col(key), F.size(parts).alias("n__"), F.posexplode(F.arrays_zip(parts.alias("content"), starts.alias("start"))).alias("i__", "p"))
    cut = cut.where(F.col("p.content").isNotNull()).select(key, "n__", F.col("p.content").alias("content"), F.col("p.start").cast("long").alias("start"))
    head = f"(?md)\\A{SECTION_HEADER}"
    number = F.regexp_extract("content", head, 1)
    alone = (F.col("n__") == 1) & (number == "")
    out = cut.where((number != "") | alone)
    title = F.when(alone, F.col("content")).otherwise(F.trim(F.regexp_extract("content", head, 2)))
    return out.select(key, F.rtrim(number, F.lit(".")).alias("number"), title.alias("title"), "start", F.length("content").cast("long").alias("length"), "content")


def first_number(caption: Column) -> Column:
    """The number of a caption such as `Table 2.3 of 7` (2.3), as text; null where it has none."""
    return F.nullif(F.regexp_extract(caption, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))


def chunk_records(rows: DataFrame, content: str, title: str, line: str) -> DataFrame:
    """rows with the span of lines, token estimates and digest of each chunk; `line` is the one it starts on. Null contents
    are left out."""
    breaks = F.length(content) - F.length(F.replace(F.col(content), F.lit("\n"), F.lit("")))
    return rows.where(F.col(content).isNotNull()).withColumns({"first_line": F.col(line).cast("long"), "last_line": (F.col(line) + breaks).cast("long"), "content_tokens": token_estimate(F.col(content)), "title_tokens": token_estimate(F.col(title)), "section_id": content_hash(F.col(content))})
