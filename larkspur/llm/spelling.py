"""Spelling variants: words at edit distance one, grouped under their most frequent form, over a whole corpus.

Every word emits itself and its distinct single deletions; words that share a key are one inserted or deleted letter apart
(one is the key), one replaced letter apart (both lose the letter at the same place), or two edits apart. A deletion
carries the stretch of places that give it (a run of equal letters), so the join itself tells these cases, and what it finds
is then compared letter by letter. A key that k words of one length emit at one place is one of k spellings that differ in a
single letter, so what shares a key is bounded by the alphabet times the word's length, whatever the corpus. A word's form
is its most frequent near word, if that is frequent enough; forms are followed to their roots by doubling.

Keys are hashes and words go by number until they are compared, so a very long word costs its length, not its square, in
moved bytes. Words are counted within each task before the shuffle. Tables here look small as files (packed words and
numbers) and are large as rows, so every join is a shuffled one by hint: none is built whole on the driver.

Defined cases: null and empty texts have no words; rows without an id are left out; repeated rows each count; words are
compared by code points, ties go to the smaller in code-point order; without near words n_near is 0, form is null and root
the word itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import slices, written

#: Distinct words that a task holds before it hands its counts on.
_HELD = 200_000
_WORD = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 1, drop_every: int | None = None) -> DataFrame:
    """(word, n) of all whole texts, A-Z lowered, of at least `shortest` code points.

    With drop_every, misspellings are planted: where that number divides the checksum of `<id>:<word>`, the word loses the
    letter that the checksum names, in all its places in that document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words, n = [w for w in held if len(w) >= shortest], [n for w, n in held.items() if len(w) >= shortest]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in (part for whole in batches for part in slices(whole, 1, 2 << 20)):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _WORD.findall((text or "").encode().lower().decode())  # bytes lower A-Z alone
                if drop_every is None:
                    held.update(words)
                else:
                    base = zlib.crc32(f"{name}:".encode())
                    for w, n in Counter(words).items():
                        if (h := zlib.crc32(w.encode(), base)) % drop_every == 0:
                            w = w[: h % len(w)] + w[h % len(w) + 1 :]
                        held[w] += n
            if len(held) > _HELD:
                yield out()
        yield out()

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _deletions(word: str) -> Column:
    """Distinct single deletions as hashed keys, each with the first and last place that gives it."""
    w = F.col(word)
    first = F.filter(F.sequence(F.lit(0), F.length(w) - 1), lambda i: (i == 0) | (F.substring(w, i + 1, 1) != F.substring(w, i, 1)))
    run = lambda i: F.length(F.regexp_extract(F.substring(w, i + 1, 2147483647), r"^(.)\1*", 0))
    return F.transform(first, lambda i: F.struct(F.xxhash64(F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, 2147483647))).alias("key"), i.alias("lo"), (i + run(i) - 1).alias("hi")))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all pairs at edit distance one among distinct words (word, n), in both directions."""
    named = written(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    whole = F.array(F.struct(F.xxhash64("word").alias("key"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi")))
    keys = named.select("id", F.length("word").alias("size"), F.explode(F.concat(whole, _deletions("word"))).alias("k")).select("k.key", "id", "size", "k.lo", "k.hi")
    a, b = keys.alias("a"), keys.alias("b").hint("merge")
    one = F.expr("a.size <> b.size OR (a.lo <= b.hi AND b.lo <= a.hi)")  # the other is the key, or a letter is replaced
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & one).select(F.col("a.id").alias("one"), F.col("b.id").alias("two"))
    first = named.select(F.col("id").alias("one"), F.col("word").alias("word"), F.col("n"))
    second = named.select(F.col("id").alias("two"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    sure = pairs.join(first.hint("merge"), "one").join(second.hint("merge"), "two").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")
    return sure.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")


def grouped(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n): form is the near word of largest n (ties: the smallest)
    where that is at least `times` the word's; root is the last of the forms that follow one another."""
    words = written(words.select("word", "n"), "vocabulary")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    strong = -F.col("best.n") >= times * F.col("n")
    formed = words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n"))
    formed = written(formed, "forms")
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # n grows with each form, so chains end; what is passed doubles each round
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    return formed.join(roots.select("word", "root").hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
