"""Searches made of ranked legs: hybrid, graph-expanded, routed by the query, over memories, compactions and QA edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import graph, rank, temporal
from larkspur.sources.inverted import Index


@dataclass
class Plan:
    """How to search: legs and their weights, how many each gives, and whether results are reranked."""

    weights: dict[str, float] = field(default_factory=lambda: {"bm25": 0.5, "semantic": 0.5})
    leg: int = 20
    n: int = 10
    rrf_k: int = 60
    rerank: bool = False
    since: Column | None = None


#: The plan for each kind of query.
PLANS = {
    "tag": Plan({"tag": 1.0}),
    "graph": Plan({"bm25": 0.4, "graph": 0.6}),
    "factual": Plan({"bm25": 0.7, "semantic": 0.3}),
    "conceptual": Plan({"bm25": 0.3, "semantic": 0.7}, rerank=True),
    "recent": Plan({"bm25": 0.6, "semantic": 0.4}),
    "exploratory": Plan({"bm25": 0.5, "semantic": 0.5}, leg=40, n=20),
}


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values()) or 1.0
    return {k: v / total for k, v in weights.items()}


def expanded(seeds: DataFrame, edges: DataFrame, key: str, max_depth: int = 1, direction: str = "any", types: list[str] | None = None, per_seed: int = 100) -> DataFrame:
    """(seed, vertex, depth): what a bounded walk from each ranked seed reaches, the nearest `per_seed` of each."""
    near = graph.neighbourhood(edges, seeds.select(F.col(key).alias("id")), 1, max_depth, direction, types)
    w = Window.partitionBy("seed").orderBy("depth", "vertex")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_seed).drop("r")


def graph_leg(seeds: DataFrame, edges: DataFrame, key: str, n: int, share: float = 0.8) -> DataFrame:
    """Seeds, and what they lead to at a share of their score; a vertex counts once at its best."""
    led = expanded(seeds, edges, key).join(seeds.select(F.col(key).alias("seed"), "score"), "seed").select(F.col("vertex").alias(key), (F.col("score") * share).alias("score"))
    best = seeds.select(key, "score").unionByName(led).groupBy(key).agg(F.max("score").alias("score"))
    return rank.ranked(best, key, n)


def hybrid(docs: DataFrame, key: str, text: str, query: str, plan: Plan, vectors: DataFrame | None = None, vector: list[float] | None = None, edges: DataFrame | None = None, tags: tuple[str, list[str]] | None = None, index: Index | None = None) -> DataFrame:
    """The plan's legs over documents that pass the tag and time filters, fused; filters hold for every leg.

    vectors has the same key and a column `embedding`; edges (src, dst) join keys of documents. With a written index of
    docs the word legs read no text; words are then weighed over all that it holds, filters or not.
    """
    rows = docs
    if plan.since is not None:
        rows = rows.where(F.coalesce(F.col("created_at") >= plan.since, F.lit(False)))
    if tags:
        rows = rank.tags(rows, tags[1], tags[0])
    weights, lists = normalised(plan.weights), {}
    if index is None:
        words = rank.bm25(rows, query, key, text).select(key, "score")
    else:
        words = index.scores(query, key) if plan.since is None and not tags else index.scores(query, key).join(rows.select(key), key, "left_semi")
    if "bm25" in weights:
        lists["bm25"] = rank.ranked(words.select(key, "score"), key, plan.leg)
    if "semantic" in weights and vectors is not None and vector:
        lists["semantic"] = rank.ranked(rank.vector_scores(vectors.join(rows.select(key), key, "left_semi"), "embedding", vector).select(key, "score"), key, plan.leg)
    if "graph" in weights and edges is not None:
        lists["graph"] = graph_leg(rank.ranked(words.select(key, "score"), key, plan.leg), edges, key, plan.leg)
    if "tag" in weights and tags:
        lists["tag"] = rank.ranked(rows.select(key, F.col("tag_score").alias("score")), key, plan.leg)
    found = rank.fused(lists, {k: weights[k] for k in lists}, key, plan.rrf_k).select(key, "score")
    if plan.rerank:
        full = rank.top(found, plan.leg, key).join(docs.select(key, text), key)
        return rank.reranked(full, rank.overlap_score(F.col(text), query), plan.n, key).select(key, F.col("final_score").alias("score"))
    return rank.top(found, plan.n, key)


def kind_of(query: str) -> str:
    """The kind of one query text, by the same rules as the column expression `rank.route`."""
    import re

    low = query.lower()
    for kind, signs in rank._KINDS:
        if any((s in low) if kind == "tag" else re.search(rf"\b{s}\b", low) for s in signs):
            return kind
    return "exploratory"


def routed(docs: DataFrame, key: str, text: str, query: str, **legs) -> DataFrame:
    return hybrid(docs, key, text, query, PLANS[kind_of(query)], **legs)


def memories(messages: DataFrame, key: str, query: str, vector: list[float] | None, n: int = 10, conversation=None, at: Column | None = None) -> DataFrame:
    """By vector, scored (cosine + 1) / 2, where nothing filters; else by words over what was known and valid then."""
    if conversation is None and at is None and vector:
        near = rank.vector_scores(messages, "embedding", vector).withColumn("score", (F.col("score") + 1) / 2)
        return rank.top(near, n, key)
    rows = messages if conversation is None else messages.where(F.col("conversation_id") == conversation)
    rows = rows if at is None else rows.where(temporal.known(at))
    return rank.top(rank.bm25(rows, query, key, "content"), n, key)


def compactions(rows: DataFrame, key: str, vector: list[float], n: int = 5, floor: float = 0.75, methods: list[str] | None = None) -> DataFrame:
    where = F.col("compaction_method").isin(methods) if methods else None
    return rank.vector_search(rows, "embedding", vector, n, key, floor=floor, where=where)


def qa_edges(edges: DataFrame, query: str, key: str, n: int, floor: float = 0.0) -> DataFrame:
    """10 x the relevance of both texts, and 2 and 3 more where the question and the answer hold a word of the query."""
    terms = rank.query_words(query)
    has = lambda c: F.lit(False) if not terms else F.exists(F.array(*map(F.lit, terms)), lambda t: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t))
    scored = rank.bm25(edges.where(F.col("confidence") >= floor), query, key, ["question", "answer"])
    total = 10 * F.col("score") + 2 * has("question").cast("double") + 3 * has("answer").cast("double")
    return rank.top(scored.withColumn("score", total), n, key)
