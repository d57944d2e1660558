"""Ranked retrieval: postings and BM25, phrase and tag search, exact vector search, rank fusion and reranking.

Search operators score every document with expressions over its own row, so a query costs one scan for the corpus
statistics and one for the scores, and no shuffle but the final top-k. Ties always go to the smaller key.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import vector
from larkspur.functions.text import words

K1, B = 1.2, 0.75


def query_words(query: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): the inverted index as a table, for corpora that are searched often; write it sorted by term."""
    tokens = docs.select(key, words(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens"))
    return tokens.select(key, "dl", F.explode("tokens").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf")).select(key, "term", "tf", "dl")


def _equals(term: str):
    return lambda w: w == F.lit(term)


def _bm25(tf: Column, dl: Column, idf: Column, average: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, query: str, key: str, text: str | list[str]) -> DataFrame:
    """docs with `score`; only rows with a query word in a field stay. The corpus is docs, so filter it first."""
    fields = [text] if isinstance(text, str) else text
    terms = query_words(query)
    rows = docs.withColumn("w__", F.flatten(F.array(*(words(F.col(f)) for f in fields)))).withColumn("dl__", F.size("w__").cast("double"))
    tf = {t: F.size(F.filter("w__", _equals(t))).cast("double") for t in terms}
    rows = rows.withColumns({f"tf{i}__": c for i, c in enumerate(tf.values())})
    stats = rows.agg(F.count("*").cast("double").alias("n__"), F.avg("dl__").alias("avg__"), *(F.count_if(F.col(f"tf{i}__") > 0).cast("double").alias(f"df{i}__") for i in range(len(terms))))
    scored = rows.crossJoin(F.broadcast(stats))  # one row
    parts = [_bm25(F.col(f"tf{i}__"), F.col("dl__"), _idf(F.col("n__"), F.col(f"df{i}__")), F.col("avg__")) for i in range(len(terms))]
    found = scored.where(" OR ".join(f"tf{i}__ > 0" for i in range(len(terms))) or "false")
    return found.withColumn("score", sum(parts, F.lit(0.0))).select(*docs.columns, "score")


def bm25_from_postings(index: DataFrame, query: str, key: str) -> DataFrame:
    """(key, score) from a written index: only the query's terms are read where it is sorted by term."""
    terms = query_words(query)
    stats = index.select(key, "dl").distinct().agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("average"))
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # as many rows as query words, and one row
    return scored.groupBy(key).agg(F.sum(_bm25(F.col("tf").cast("double"), F.col("dl").cast("double"), _idf(F.col("n"), F.col("df")), F.col("average"))).alias("score"))


def top(rows: DataFrame, n: int, key: str, score: str = "score", offset: int = 0, floor: float | None = None) -> DataFrame:
    if floor is not None:
        rows = rows.where(F.col(score) >= floor)
    return rows.orderBy(F.desc(score), key).offset(offset).limit(n)


def ranked(rows: DataFrame, key: str, n: int, score: str = "score") -> DataFrame:
    """The n best rows with `rank` from 1; the window sees n rows."""
    return top(rows, n, key, score).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def phrase(docs: DataFrame, term: str, fields: list[str]) -> DataFrame:
    """docs that hold the phrase between word bounds in a field; score 1 where the case agrees too, else 0.9."""
    whole = r"(?i)(?<![\p{L}\p{N}])" + re.escape(term) + r"(?![\p{L}\p{N}])"
    hit = F.lit(False)
    exact = F.lit(False)
    for f in fields:
        hit, exact = hit | F.coalesce(F.col(f).rlike(whole), F.lit(False)), exact | F.coalesce(F.col(f).contains(term), F.lit(False))
    return docs.where(hit).withColumn("score", F.when(exact, 1.0).otherwise(0.9))


def substring(docs: DataFrame, term: str, field: str) -> DataFrame:
    return docs.where(F.lower(F.col(field)).contains(term.lower()))


def _cut(word: str, most: int) -> set[str]:
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def deletion_keys(words_: DataFrame, most: Column, deepest: int) -> DataFrame:
    """(word, key) of each distinct word: the word and all it becomes by losing up to `most` (at most `deepest`) letters."""
    less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    level = words_.select("word", most.alias("most"), F.array("word").alias("now")).withColumn("keys", F.col("now"))
    for n in range(1, deepest + 1):
        further = F.array_distinct(F.flatten(F.transform(F.filter("now", lambda s: s != ""), less)))
        level = level.withColumn("now", F.when(F.col("most") >= n, further).otherwise(F.array().cast("array<string>"))).withColumn("keys", F.concat("keys", "now"))
    return level.select("word", F.explode_outer("keys").alias("key"))  # never empty; a plain explode would test that before other filters


def _may_be_close(term: str, c: float) -> Column:
    """What a word of a ratio of at least c holds: as many letters in common, and no more edits than letters may be lost."""
    size, word = F.length("word"), F.col("word")
    shared = sum((F.least(size - F.length(F.replace(word, F.lit(x), F.lit(""))), F.lit(n)) for x, n in Counter(term).items()), F.lit(0))
    longest = math.floor(len(term) * (2 - c) / c + 1e-9)
    edits = F.levenshtein("word", F.lit(term), math.floor((1 - c) * (len(term) + longest) + 1e-9))
    return (2 * shared >= c * (size + len(term)) - 1e-9) & (edits >= 0) & (edits <= F.floor((1 - c) * (size + len(term)) + 1e-9))


def close_words(words_: DataFrame, terms: list[str], cutoff: float) -> DataFrame:
    """(term, word, similarity) of distinct words (word) with a ratio of at least cutoff to one of a few stated terms.

    The ratio is 200 times the longest common subsequence over both lengths, and words share a subsequence where both become
    it by losing letters: they meet by an equi-join on what deletions leave, and the longest key they share is the answer.
    How many letters a word may lose follows from the lengths and the cutoff, so nothing is missed; where few terms are
    asked for, letters in common and a bounded edit distance first leave out words that are near none of them.
    """
    c, terms = cutoff / 100, sorted({t.lower() for t in terms if t})
    if not terms:
        return words_.select(F.lit("").alias("term"), "word", F.lit(0.0).alias("similarity")).limit(0)
    size, lengths = F.length("word"), sorted({len(t) for t in terms})
    lost = {n: F.floor(size - c * (n + size) / 2 + 1e-9) for n in lengths}
    fits = {n: size.between(math.ceil(n * c / (2 - c) - 1e-9), math.floor(n * (2 - c) / c + 1e-9)) for n in lengths}
    most = F.greatest(F.lit(-1), *(F.when(fits[n], lost[n]).otherwise(-1) for n in lengths)).cast("int")
    longest = math.floor(lengths[-1] * (2 - c) / c + 1e-9)
    deepest = max(0, *(math.floor(b - c * (n + b) / 2 + 1e-9) for n in lengths for b in range(1, longest + 1) if n * c / (2 - c) - 1e-9 <= b <= n * (2 - c) / c + 1e-9))
    rows = words_.where(most >= 0)
    if len(terms) <= 8:
        rows = rows.where(F.array_contains(F.array(*(_may_be_close(t, c) for t in terms)), True))
    keys = deletion_keys(rows, most, deepest)
    asked = [(t, k) for t in terms for k in _cut(t, max(0, math.floor(len(t) * (2 - 2 * c) / (2 - c) + 1e-9)))]
    met = keys.join(F.broadcast(words_.sparkSession.createDataFrame(asked, "term string, key string")), "key")  # the stated terms
    found = met.groupBy("term", "word").agg((200.0 * F.max(F.length("key")) / (F.length("term") + F.length("word"))).alias("similarity"))
    return found.where(F.col("similarity") >= cutoff)


def fuzzy_words(docs: DataFrame, term: str, field: str, cutoff: float, key: str) -> DataFrame:
    """(key, word, similarity) of distinct words of each row with a ratio of at least cutoff."""
    n, c = len(term), cutoff / 100
    short, long = n * c / (2 - c), n * (2 - c) / c  # ratio <= 2 min / (a + b)
    candidates = docs.select(key, F.explode(F.array_distinct(words(F.col(field)))).alias("word")).where(F.length("word").between(math.ceil(short - 1e-9), math.floor(long + 1e-9)))
    near = close_words(candidates.select("word").distinct(), [term], cutoff).select("word", "similarity")
    return candidates.join(near, "word").select(key, "word", "similarity")


def fuzzy_filter(rows: DataFrame, term: str, field: str, cutoff: float = 80.0) -> DataFrame:
    from larkspur.functions.text import token_set_ratio_udf

    return rows.withColumn("similarity", token_set_ratio_udf(F.col(field), F.lit(term))).where(F.col("similarity") >= cutoff)


def tags(docs: DataFrame, wanted: list[str], column: str, require_all: bool = False) -> DataFrame:
    """Filter by exact tags; the score counts matches without regard to case."""
    has = [F.array_contains(column, t) for t in wanted]
    keep = has[0]
    for h in has[1:]:
        keep = keep & h if require_all else keep | h
    lower = F.array(*(F.lit(t.lower()) for t in dict.fromkeys(wanted)))
    score = F.size(F.array_intersect(F.transform(column, F.lower), lower)) / F.lit(len(dict.fromkeys(wanted)))
    return docs.where(keep).withColumn("tag_score", score)


def vector_scores(rows: DataFrame, column: str, query: list[float], measure: str = "cosine") -> DataFrame:
    """rows with `score`: cosine, dot, or the negative squared distance (`l2`)."""
    q, v = vector.literal(query), vector.doubles(F.col(column))
    score = {"cosine": vector.cosine, "dot": vector.dot, "l2": lambda a, b: -vector.squared_distance(a, b)}[measure](v, q)
    return rows.where(F.size(column) == len(query)).withColumn("score", score)


def vector_search(rows: DataFrame, column: str, query: list[float], n: int, key: str, floor: float | None = None, measure: str = "cosine", where: Column | None = None) -> DataFrame:
    """Exact search; the filter applies before the cut, so n results come back wherever n rows pass it."""
    rows = rows if where is None else rows.where(where)
    return top(vector_scores(rows, column, query, measure), n, key, floor=floor)


def vector_distances(rows: DataFrame, column: str, query: list[float], n: int, key: str, floor: float = 0.5) -> DataFrame:
    """The n nearest rows by `distance` (1 - cosine), the nearest first, of those at a cosine of at least floor."""
    found = vector_scores(rows, column, query).where(F.col("score") >= floor).withColumn("distance", 1 - F.col("score"))
    return found.orderBy("distance", key).limit(n)


def readiness(rows: DataFrame, column: str) -> DataFrame:
    """One row: counts with and without vectors, lengths seen, and whether vector search can run."""
    v = F.col(column)
    stats = rows.agg(F.count("*").alias("total"), F.count(v).alias("embedded"), F.count_if(v.isNull()).alias("missing"), F.sort_array(F.collect_set(F.when(v.isNotNull(), F.size(v)))).alias("lengths"))
    return stats.withColumn("ready", (F.col("embedded") >= 2) & (F.size("lengths") == 1))


def fused(lists: dict[str, DataFrame], weights: dict[str, float], key: str, k: int = 60) -> DataFrame:
    """(key, rank_<list>..., score): weighted reciprocal rank fusion of top lists (key, rank).

    A key that a list lacks counts as one rank beyond its end. Lists are top-n results, so the joins are small.
    """
    out, total = None, F.lit(0.0)
    for name, rows in lists.items():
        one = rows.select(key, F.col("rank").alias(f"rank_{name}"))
        out = one if out is None else out.join(one, key, "full")
    for name, rows in lists.items():
        out = out.crossJoin(F.broadcast(rows.agg((F.count("*") + 1).alias(f"end_{name}"))))  # one row
        total = total + F.lit(float(weights[name])) / (F.lit(float(k)) + F.coalesce(F.col(f"rank_{name}"), F.col(f"end_{name}")))
    return out.withColumn("score", total).select(key, *(f"rank_{n}" for n in lists), "score")


def overlap_score(text: Column, query: str) -> Column:
    """0.4 + 0.4 x the share of the query's words of over two letters that the text contains; 0.5 without such words."""
    terms = [w for w in query.lower().split() if len(w) > 2]
    if not terms:
        return F.lit(0.5)
    low = F.lower(F.coalesce(text, F.lit("")))
    found = sum((F.when(low.contains(t), 1.0).otherwise(0.0) for t in dict.fromkeys(terms)), F.lit(0.0))
    return F.lit(0.4) + F.lit(0.4) * found / len(dict.fromkeys(terms))


def passage(fields: list[str], most: int = 10_000) -> Column:
    return F.substring(F.coalesce(*(F.nullif(F.trim(F.col(f)), F.lit("")) for f in fields), F.lit("")), 1, most)


def reranked(rows: DataFrame, rerank: Column, n: int, key: str, strategy: str = "weighted", weights: tuple[float, float] = (0.3, 0.7), score: str = "score") -> DataFrame:
    old = F.col(score)
    new = {"replace": rerank, "weighted": weights[0] * old + weights[1] * rerank, "max": F.greatest(old, rerank), "min": F.least(old, rerank)}[strategy]
    return rows.withColumn("rerank_score", rerank).withColumn("final_score", new).orderBy(F.desc("final_score"), key).limit(n)


#: Words that tell kinds of questions apart, tried in this order after tags and graph words.
_KINDS = [
    ("tag", ["tag:", "#"]),
    ("graph", ["related", "connected", "linked", "graph"]),
    ("factual", ["what", "when", "where", "how many", "how much"]),
    ("conceptual", ["why", "explain", "understand", "theory"]),
    ("recent", ["recent", "latest", "today", "yesterday", "last"]),
]


def route(query: Column) -> Column:
    """The kind of search that a query text asks for; words must stand whole."""
    out = F.lit("exploratory")
    for kind, signs in reversed(_KINDS):
        hit = F.lit(False)
        for s in signs:
            hit = hit | (F.lower(query).contains(s) if kind == "tag" else F.lower(query).rlike(rf"\b{s}\b"))
        out = F.when(hit, kind).otherwise(out)
    return out


def majority_label(neighbours: DataFrame, group: str, label: str, on_tie: str) -> DataFrame:
    """The most frequent label of each group's neighbours; ties give `on_tie`."""
    counts = neighbours.groupBy(group, label).count()
    best = counts.groupBy(group).agg(F.max("count").alias("most"))
    return counts.join(best, group).where("count = most").groupBy(group, "most").agg(F.when(F.count("*") > 1, F.lit(on_tie)).otherwise(F.min(F.col(label).cast("string"))).alias("label"))

