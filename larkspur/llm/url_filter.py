"""URL filters: rules by host and path prefix, and a list of canonical URLs, behind one blocked Bloom filter.

Every key that could settle a URL (its host suffixes and path prefixes of the shapes that rules have, and its canonical
form) is tested in a Bloom filter of 256-bit blocks, one block a key; possible hits go to an exact hash join that removes
false positives. The filter is a table of blocks made and probed by built-in functions; blocks and rules are broadcast
only below a counted bound and joined by shuffle above it.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and is not listed; of the rules
that fit the longest wins, then the one with the longer host; rows with a null id stay; repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import small, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of a 256-bit block on average, bits a key sets, and rows (48 bytes each) up to which blocks or keys are broadcast.
_PER_BLOCK, _BITS, _BROADCAST = 16, 8, 500_000


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host_: Column, path_: Column) -> Column:
    """Host without a leading www. and path without a closing slash."""
    return F.concat(F.regexp_replace(host_, r"^www\.", ""), F.regexp_replace(path_, "/$", ""))


def _places(key: Column, blocks: int) -> dict[str, Column]:
    spread = F.xxhash64(key, F.lit(1))
    bits = F.array(*(F.shiftrightunsigned(spread, 8 * i).bitwiseAND(255) for i in range(_BITS)))
    mask = lambda k: F.aggregate(F.filter(bits, lambda p: F.shiftright(p, 6) == k), F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))))
    return {"block": F.pmod(F.xxhash64(key), F.lit(blocks))} | {f"m{k}": mask(k) for k in range(4)}


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3): the bits that the keys set."""
    placed = keys.select(*(c.alias(n) for n, c in _places(F.col("key"), blocks).items()))
    return placed.groupBy("block").agg(*(F.bit_or(f"m{k}").alias(f"w{k}") for k in range(4)))


def may_hold(rows: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows whose `key` the filter may hold: all that it holds, and few others."""
    placed = rows.withColumns(_places(F.col("key"), n_blocks)).join(small(blocks, _BROADCAST), "block")
    for k in range(4):
        placed = placed.where(F.col(f"w{k}").bitwiseAND(F.col(f"m{k}")) == F.col(f"m{k}"))
    return placed.select(*rows.columns)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row.

    rules are (host, path prefix, verdict); listed holds canonical URLs in its column `url`. A rule's verdict goes first,
    then a listed URL is blocked and any other allowed.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    ruled = spark.createDataFrame([(f"rule {h}|{p}", h + p, v, len(h)) for h, p, v in rules], "key string, rule string, judgement string, host_length int")
    exact = listed.where("url is not null").select(F.concat(F.lit("url "), "url").alias("key")).distinct()
    keys = written(ruled.select("key").unionByName(exact), "keys")
    n_blocks = max(1, -(-keys.count() // _PER_BLOCK))
    blocks = written(bloom_blocks(keys, n_blocks), "blocks")
    shapes = sorted({(len(h.split(".")), len(p)) for h, p, _ in rules})
    labels = F.split("host", r"\.")
    fits = [F.when((F.size(labels) >= n) & (F.length("path") >= m), F.concat(F.lit("rule "), F.array_join(F.slice(labels, -n, n), "."), F.lit("|"), F.substring("path", 1, m))) for n, m in shapes]
    url = F.when(F.col("host") != "", F.concat(F.lit("url "), canonical(F.col("host"), F.col("path"))))
    asked = rows.select("row", F.explode(F.array_compact(F.array(*fits, url))).alias("key"))
    hits = written(may_hold(asked, blocks, n_blocks), "hits")
    best = F.struct(F.length("rule").alias("n"), "host_length", "rule", "judgement")
    by_rule = hits.join(small(ruled, _BROADCAST), "key").groupBy("row").agg(F.max(best).alias("best")).select("row", "best.rule", "best.judgement")
    by_list = hits.join(small(keys.where(F.col("key").startswith("url ")), _BROADCAST), "key").select("row").distinct().withColumn("listed", F.lit(True))
    out = rows.join(by_rule, "row", "left").join(by_list, "row", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return out.select("page_id", "host", "path", "rule", F.coalesce("judgement", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
