"""A training corpus from raw documents: each stage takes all that its predecessor kept and its decisions take effect.

Texts that score as toxic go; lines that a smaller id holds too are cut; of near copies (five-word shingles, Jaccard 0.8)
one stays; documents are sampled to target token shares; what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import line_dedup, ngram_join, packing, queries, toxicity
from larkspur.llm.common import made, release, shared_dir, small, written

TOKENIZER, CAPACITY = public_tokenizers.path("word_bpe_49k.json"), 2048


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Empty and null texts score the base rate of the labels, so they stay unless most labels are toxic; rows without an id
    go; an empty table stays empty."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, if only as an empty text; a null text becomes an empty one; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    new = {"text": F.col("kept__"), "n_chars": F.length("kept__").cast("long")}
    return kept.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group stays, with all rows that repeat it; texts without words are in no group and stay."""
    return ngram_join.one_of_each(docs, words=5, num=80, den=100)


def sample_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null categories count as `other`; documents without tokens stay with their cell's probability, or surely in a cell
    without any tokens."""
    stay = written(queries.mixed(docs, spark, sf_dir, queries.TARGETS).where("stays__").select("doc_id").distinct(), "stay")
    return docs.join(small(stay, 1_000_000), "doc_id", "left_semi").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of pieces, with a checksum in place of their ids; `packing.tokenised` gives the ids of (doc_id, piece). An
    empty or null text is the end id alone."""
    pieces = packing.tokenised(docs, TOKENIZER, CAPACITY)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), CAPACITY)


STAGES = [("toxicity", remove_toxic), ("line_dedup", cut_repeated_lines), ("ngram_join", remove_near_copies), ("mixing", sample_to_targets), ("packing", pack_sequences)]
#: Model scores, chains of near copies and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written in the shared folder and read again by the next.

    What a stage wrote on its way is deleted once its result is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path, before = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}", made()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, before)
        docs = spark.read.parquet(path)
    return docs
