"""A written inverted index: postings in buckets of terms, sorted, with bounds of what a block of documents can score.

A segment holds what one `add` indexed, so another source is added without a rebuild. Its postings (term, block, key, tf,
dl) lie in folders by bucket of the term and are sorted by term and block, so a lookup opens the folders of its words and reads
their row groups. A block is some `BLOCK` documents of like length: what long documents score for frequent words and short
ones for rare words differs most by length. `bounds` has, for each term and block, how many documents hold the term, the
largest tf and the least dl / tf. BM25 falls in 1 / tf and in dl / tf, so these bound any score of the block, whatever the
average length becomes as segments are added.

A search scores the blocks of highest bound first and stops where no other block can reach the n-th score. Frequent terms
are spread over files by block, so that no task writes or reads all postings of a word.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import words
from larkspur.operators.rank import K1, B, close_words, query_words, top
from larkspur.sources.shared import dropped, shared_dir

#: Folders that terms are dealt to, documents of a block, and postings that a task writes.
BUCKETS, BLOCK, WRITTEN = 64, 4096, 2_000_000


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def term_counts(text: Column) -> Column:
    """(terms, dl): the (term, tf) of each distinct word of a text and how many words it has, without a shuffle, as sorted words
    fall into runs."""

    def of(w: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        runs = F.transform(F.array(first), lambda a: F.zip_with(a, F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.size(w))), lambda x, y: F.struct(F.get(w, x).alias("term"), (y - x).alias("tf"))))
        return F.struct(F.when(F.size(w) > 0, runs[0]).alias("terms"), F.size(w).alias("dl"))

    return F.transform(F.array(F.sort_array(words(text))), of)


class Index:
    """A folder with segments. Open it by its path; `add` builds a segment, `search` and `scores` look words up."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.scored_blocks, self.known_blocks = 0, 0
        self.refresh()

    def refresh(self) -> None:
        """See the segments that are complete: their row in `stats` is written last."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stats")
        self.segments: list[str] = []
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return
        stats = self.spark.read.parquet(f"{self.path}/stats").collect()  # a row a segment
        self.segments = [r["segment"] for r in stats]
        self.documents, self.length = sum(r["documents"] for r in stats), sum(r["length"] for r in stats)
        self._postings = self.spark.read.parquet(f"{self.path}/postings").where(F.col("segment").isin(self.segments))
        self._bounds = self.spark.read.parquet(f"{self.path}/bounds").where(F.col("segment").isin(self.segments))

    def add(self, docs: DataFrame, key: str, text: str) -> None:
        """Index rows whose keys no segment holds yet; null and empty texts count towards the average length only."""
        segment, forward = f"s-{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/forward-{uuid.uuid4().hex}"
        counted = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.inline(term_counts(F.col(text))))
        counted.withColumn("kind", F.floor(4 * F.log2(F.greatest("dl", F.lit(1))))).write.parquet(forward)
        rows = self.spark.read.parquet(forward)
        kinds = rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("dl").alias("length"), F.sum(F.coalesce(F.size("terms"), F.lit(0))).alias("postings")).collect()  # as many as lengths double, times 4
        slices = F.create_map(*(F.lit(x) for k in kinds for x in (k["kind"], math.ceil(k["n"] / BLOCK)))) if kinds else F.create_map(F.lit(0), F.lit(1))
        block = F.col("kind") * (1 << 32) + F.pmod(F.xxhash64("key"), F.element_at(slices, F.col("kind")))
        parts = max(1, math.ceil(sum(k["postings"] for k in kinds) / (BUCKETS * WRITTEN)))
        postings = rows.select("key", "dl", block.alias("block"), F.explode("terms").alias("t")).select("t.term", "block", "key", "t.tf", "dl", bucket(F.col("t.term")).alias("bucket"))
        place = (F.col("bucket") * parts + F.pmod("block", F.lit(parts))).cast("int")  # a task each: hashed, several would meet in one
        dealt = postings.repartitionById(BUCKETS * parts, place).sortWithinPartitions("bucket", "term", "block", "key")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        written = self.spark.read.schema(postings.schema).parquet(f"{self.path}/postings/segment={segment}")
        bounds = written.groupBy("term", "block", "bucket").agg(F.count("*").alias("df"), F.max("tf").alias("most_tf"), F.min(F.col("dl") / F.col("tf")).alias("least_ratio"))
        bounds.repartitionById(BUCKETS * parts, place).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{self.path}/bounds/segment={segment}")
        stats = self.spark.createDataFrame([(segment, sum(k["n"] for k in kinds), int(sum(k["length"] or 0 for k in kinds)))], "segment string, documents long, length long")
        stats.coalesce(1).write.mode("append").parquet(f"{self.path}/stats")
        dropped(self.spark, forward)
        self.refresh()

    def _of(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        """Rows of some words; the words' folders are constants of the plan, so others are never opened."""
        return rows.where(F.col("bucket").isin([bucket(F.lit(t)) for t in terms]) & F.col("term").isin(terms))

    def _weights(self, bounds: DataFrame) -> Column | None:
        """The inverse document frequency of each word that is known, over all segments."""
        df = {r["term"]: float(r["df"]) for r in bounds.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # the query's words
        idf = {t: math.log(1 + (self.documents - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        return F.element_at(F.create_map(*(F.lit(x) for p in idf.items() for x in p)), F.col("term")) if idf else None

    def _score(self, idf: Column, hits: DataFrame) -> DataFrame:
        average = F.lit(self.length / self.documents)
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
        return hits.groupBy("key").agg(F.sum(part).alias("score"))

    def _nothing(self, key: str) -> DataFrame:
        return self.spark.createDataFrame([], f"`{key}` long, score double")

    def scores(self, query: str, key: str = "key") -> DataFrame:
        """(key, score) of every document with a word of the query."""
        terms = query_words(query)
        if not terms or not self.segments or (idf := self._weights(self._of(self._bounds, terms))) is None:
            return self._nothing(key)
        return self._score(idf, self._of(self._postings, terms)).withColumnRenamed("key", key)

    def vocabulary(self) -> DataFrame:
        """(word) of all words that a segment holds."""
        return self._bounds.select(F.col("term").alias("word")).distinct()

    def fuzzy(self, term: str, cutoff: float, key: str = "key") -> DataFrame:
        """(key, word, similarity) of documents with a word close to a term: no text is read, only the words and their postings."""
        near = close_words(self.vocabulary(), [term], cutoff).select("word", "similarity")
        hits = self._postings.select(F.col("term").alias("word"), F.col("key").alias(key))
        return hits.join(near, "word").select(key, "word", "similarity")

    def search(self, query: str, n: int, key: str = "key", wave: int = 64) -> DataFrame:
        """(key, score) of the n best, ties to the smaller key: `wave` blocks are scored, and more only where they can matter."""
        terms = query_words(query)
        bounds = self._of(self._bounds, terms) if terms and self.segments else None
        if bounds is None or (idf := self._weights(bounds)) is None:
            return self._nothing(key)
        most = idf * (K1 + 1) / (1 + K1 * (1 - B) / F.col("most_tf") + K1 * B * self.documents / self.length * F.col("least_ratio"))
        blocks = bounds.groupBy("segment", "block").agg((F.sum(most) * (1 + 1e-9)).alias("bound"))
        first = blocks.orderBy(F.desc("bound"), "segment", "block").limit(wave + 1).collect()
        hits = self._of(self._postings, terms)
        chosen = F.broadcast(self.spark.createDataFrame([(r["segment"], r["block"]) for r in first[:wave]], "segment string, block long"))
        near = hits.where(F.col("block").isin([r["block"] for r in first[:wave]])).join(chosen, ["segment", "block"], "left_semi")
        best = top(self._score(idf, near), n, "key").collect()
        self.scored_blocks, self.known_blocks = min(len(first), wave), blocks.count() if len(first) > wave else len(first)
        if len(first) > wave and (len(best) < n or first[wave]["bound"] >= best[-1]["score"]):
            floor = best[-1]["score"] if len(best) == n else 0.0
            matter = blocks.where(F.col("bound") >= floor)
            self.scored_blocks = matter.count()
            return top(self._score(idf, hits.join(matter.select("segment", "block"), ["segment", "block"], "left_semi")), n, "key").withColumnRenamed("key", key)
        schema = hits.select(F.col("key").alias(key)).schema.add("score", "double")
        return self.spark.createDataFrame([tuple(r) for r in best], schema)
