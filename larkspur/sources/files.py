"""Readers and writers: JSON with a schema, document blocks, JSON lines, CSV, Parquet; all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "document_id string, pages array<struct<page_number int, blocks array<struct<type string, text string, level int>>>>"
MESSAGES = "messages array<struct<role string, content string>>, metadata map<string,string>"
THREATS = "collections struct<tactics array<struct<_key string, name string>>, techniques array<struct<_key string, name string, severity string, tactic_ids array<string>>>>, edges map<string, array<struct<_from string, _to string>>>"
TECHNIQUES = "tactics array<struct<id string, name string>>, techniques array<struct<id string, name string, severity string, tactic_ids array<string>>>"


def json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A leading byte-order mark is skipped by the reader; fields that a row lacks are null."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def document_blocks(spark: SparkSession, path: str) -> DataFrame:
    return exploded_blocks(json(spark, path, BLOCKS))


def exploded_blocks(documents: DataFrame) -> DataFrame:
    pages = documents.select("document_id", F.posexplode("pages").alias("page", "p"))
    return pages.select("document_id", "page", F.posexplode("p.blocks").alias("idx", "b")).select("document_id", "page", "idx", "b.type", "b.text", "b.level")


def chat(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return json(spark, path, MESSAGES, lines)


def techniques(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row a technique and tactic."""
    t = json(spark, path, TECHNIQUES, lines).select(F.explode("techniques").alias("t")).select("t.*")
    return t.withColumn("tactic_id", F.explode("tactic_ids")).drop("tactic_ids")


def threats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tactics, techniques and edges (type, _from, _to) of an import; of rows with one key the import keeps one."""
    whole = json(spark, path, THREATS)
    rows = lambda name: whole.select(F.explode(f"collections.{name}").alias("r")).select("r.*").dropDuplicates(["_key"])
    edges = whole.select(F.explode("edges").alias("type", "e")).select("type", F.explode("e").alias("e")).select("type", "e.*")
    return rows("tactics"), rows("techniques"), edges


def seeded(spark: SparkSession, path: str, collections: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a seed file, a JSON object with a list of rows for each collection; collections gives their schemas, and
    a list that the file lacks is an empty table."""
    whole = json(spark, path, ", ".join(f"`{name}` array<struct<{schema}>>" for name, schema in collections.items()))
    return {name: whole.select(F.explode(F.col(f"`{name}`")).alias("r")).select("r.*") for name in collections}


#: Breaks and outer white space of texts stay; a null is nothing, an empty text two quotes.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `write` wrote as csv, compressed or not."""
    return spark.read.options(**_CSV, multiLine=True, nullValue="\x00").schema(schema).csv(path)  # else two quotes would be null too


def write(df: DataFrame, path: str, fmt: str = "json", compression: str | None = None, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.options(**_CSV)
    if compression:
        w = w.option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).format(fmt).save(path)


def json_array(df: DataFrame) -> DataFrame:
    """One row with all rows as a JSON array; for small results such as a drawing's nodes."""
    return df.select(F.to_json(F.struct("*")).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("json"))
