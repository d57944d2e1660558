"""Ranked retrieval over documents and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import vector
from larkspur.operators import ivf, matrix, rank
from larkspur.plans.registry import query, table
from larkspur.sources.inverted import Index
from larkspur.sources.shared import shared_dir

Q = "the nation of with"
TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_TERMS = "('the'), ('nation'), ('of'), ('with')"
BM25 = f"""d AS (SELECT doc_id, text, lang, source, {TOKENS} AS w FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)::DOUBLE) AS a FROM d),
q(t) AS (VALUES {_TERMS}),
df AS (SELECT t, count(*)::DOUBLE AS df FROM q JOIN d ON list_contains(w, t) GROUP BY t),
b AS (SELECT doc_id, lang, source, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / a))) AS score
  FROM (SELECT d.*, df.df, len(list_filter(w, lambda x: x = t))::DOUBLE AS tf FROM d JOIN df ON list_contains(w, t)), st GROUP BY doc_id, lang, source)"""
VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q0 AS (SELECT e AS q FROM v WHERE vec_id = 0)"
COS = "list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q)))"


def _query_vector(emb: DataFrame) -> list[float]:
    """The stored vector 0 stands in for an embedded query text."""
    return [float(x) for x in emb.where("vec_id = 0").first()["embedding"]]


_INDEXES: dict[tuple[str, str], Index] = {}


def text_index(spark, sf) -> Index:
    """The written index of all documents' texts: built on first use in a session, opened afterwards."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _INDEXES:
        index = Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
        index.add(table(spark, sf, "documents"), "doc_id", "text")
        _INDEXES[at] = index
    return _INDEXES[at]


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf):
    return _rounded(text_index(spark, sf).search(Q, 10, "doc_id"), "score")


@query(f"WITH {BM25}, f AS (SELECT *, count(*) OVER () AS total FROM b WHERE score >= 0.5 AND lang = 'en') SELECT doc_id, round(score, 6) AS score, total FROM f ORDER BY f.score DESC, doc_id LIMIT 20 OFFSET 10")
def bm25_paged_total(spark, sf):
    found = text_index(spark, sf).scores(Q, "doc_id").where("score >= 0.5")
    hits = found.join(table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), "doc_id")
    total = hits.agg(F.count("*").alias("total"))
    return _rounded(rank.top(hits, 20, "doc_id", offset=10).crossJoin(F.broadcast(total)), "score")


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 10")
def bm25_postings(spark, sf):
    """All documents with a word of the query are scored from the index."""
    return _rounded(rank.top(text_index(spark, sf).scores(Q, "doc_id"), 10, "doc_id"), "score")


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 10")
def bm25_segments(spark, sf):
    """The same from an index of two segments: documents of odd ids are added later, without a rebuild."""
    index = Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    docs = table(spark, sf, "documents")
    index.add(docs.where("doc_id % 2 = 0"), "doc_id", "text")
    index.add(docs.where("doc_id % 2 = 1"), "doc_id", "text")
    return _rounded(index.search(Q, 10, "doc_id"), "score")


@query(f"WITH {BM25} SELECT doc_id, lang, round(score, 6) AS score FROM b")
def bm25_scan(spark, sf):
    """Every match of a corpus that is not indexed, by two passes over its texts."""
    return _rounded(rank.bm25(table(spark, sf, "documents").select("doc_id", "lang", "text"), Q, "doc_id", "text").select("doc_id", "lang", "score"), "score")


@query(r"""SELECT doc_id, CASE WHEN contains(text, 'in the') THEN 1.0 ELSE 0.9 END::DOUBLE AS score FROM documents
WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])in the([^\p{L}\p{N}]|$)')""")
def phrase_search(spark, sf):
    return rank.phrase(table(spark, sf, "documents").select("doc_id", "text"), "in the", ["text"]).select("doc_id", "score")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license')")
def substring_search(spark, sf):
    return rank.substring(table(spark, sf, "documents"), "License", "text").select("doc_id", "lang")


#: The longest common subsequence with one word, a row of the table for each letter.
_EDITS = f"""w AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS word FROM documents), v AS (SELECT DISTINCT word FROM w WHERE length(word) BETWEEN 5 AND 10),
d AS (SELECT word, list_reduce(list_prepend([0, 0, 0, 0, 0, 0, 0, 0], list_transform(string_split(word, ''), lambda c: [unicode(c)])),
  lambda a, c: list_prepend(0, list_transform(range(2, 9), lambda j: list_max(list_transform(range(2, j + 1), lambda i: greatest(a[i], a[i - 1] + CASE WHEN unicode(substr('nations', i - 1, 1)) = c[1] THEN 1 ELSE 0 END)))))) AS r FROM v),
f AS (SELECT word, 200.0 * r[8] / (7 + length(word)) AS similarity FROM d)"""


@query(f"WITH {_EDITS} SELECT doc_id, word, round(similarity, 6)::DOUBLE AS similarity FROM w JOIN f USING (word) WHERE similarity >= 80")
def fuzzy_word(spark, sf):
    """From the index's vocabulary and postings."""
    return _rounded(text_index(spark, sf).fuzzy("nations", 80.0, "doc_id"), "similarity")


@query()
def fuzzy_filter(spark, sf):
    return _rounded(rank.fuzzy_filter(table(spark, sf, "benchmark"), "the thin blees", "text", 55.0).select("item_id", "similarity"), "similarity")


def _tagged(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("tags"))


_TAG = "(CASE WHEN lower(lang) IN ('en', 'src1') AND lower(source) IN ('en', 'src1') AND lower(lang) <> lower(source) THEN 1.0 WHEN lower(lang) IN ('en', 'src1') OR lower(source) IN ('en', 'src1') THEN 0.5 ELSE 0.0 END)::DOUBLE"


@query(f"SELECT doc_id, {_TAG} AS tag_score FROM documents WHERE lang IN ('en', 'src1') OR source IN ('en', 'src1')")
def tag_any(spark, sf):
    return rank.tags(_tagged(spark, sf), ["en", "src1"], "tags").select("doc_id", "tag_score")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def tag_all(spark, sf):
    return rank.tags(_tagged(spark, sf), ["en", "src1"], "tags", True).select("doc_id")


@query("SELECT doc_id, round(((lang IN ('en', 'de'))::INT + (source IN ('src1', 'src2'))::INT) / 5.0, 6)::DOUBLE AS tag_score FROM documents WHERE lang IN ('en', 'de') OR source = 'src1'")
def tag_fraction(spark, sf):
    """Five wanted tags: two languages and one source as they are written, a source in another case, which scores but does not
    filter, and one that nothing has."""
    found = rank.tags(_tagged(spark, sf), ["en", "de", "src1", "SRC2", "SRC1x"], "tags")
    return found.select("doc_id", F.round("tag_score", 6).alias("tag_score"))


@query(f"WITH {VEC}, s AS (SELECT vec_id, {COS} AS score FROM v, q0) SELECT vec_id, round(score, 6) AS score FROM s WHERE s.score >= 0.1 ORDER BY s.score DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf):
    emb = table(spark, sf, "embeddings")
    return _rounded(rank.vector_search(emb, "embedding", _query_vector(emb), 10, "vec_id", floor=0.1).select("vec_id", "score"), "score")


@query(f"WITH {VEC} SELECT vec_id, round(list_inner_product(e, q), 6) AS score FROM v, q0 ORDER BY list_inner_product(e, q) DESC, vec_id LIMIT 10")
def dot_topk(spark, sf):
    emb = table(spark, sf, "embeddings")
    return _rounded(rank.vector_search(emb, "embedding", _query_vector(emb), 10, "vec_id", measure="dot").select("vec_id", "score"), "score")


@query(f"WITH {VEC}, s AS (SELECT vec_id, -list_sum(list_transform(list_zip(e, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS score FROM v, q0) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def l2_topk(spark, sf):
    emb = table(spark, sf, "embeddings")
    return _rounded(rank.vector_search(emb, "embedding", _query_vector(emb), 10, "vec_id", measure="l2").select("vec_id", "score"), "score")


@query(f"WITH {VEC}, s AS (SELECT vec_id, {COS} AS score FROM v, q0 WHERE label = 3) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def filtered_cosine_topk(spark, sf):
    emb = table(spark, sf, "embeddings")
    return _rounded(rank.vector_search(emb, "embedding", _query_vector(emb), 10, "vec_id", where=F.col("label") == 3).select("vec_id", "score"), "score")


@query(f"WITH {VEC}, s AS (SELECT vec_id, ({COS} + 1) / 2 AS score FROM v, q0) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def memory_score_norm(spark, sf):
    emb = table(spark, sf, "embeddings")
    scored = rank.vector_scores(emb, "embedding", _query_vector(emb)).withColumn("score", (F.col("score") + 1) / 2)
    return _rounded(rank.top(scored, 10, "vec_id").select("vec_id", "score"), "score")


@query("SELECT count(*) AS total, count(embedding) AS embedded, count(*) FILTER (WHERE embedding IS NULL) AS missing, count(embedding) >= 2 AND count(DISTINCT len(embedding)) = 1 AS ready FROM embeddings")
def semantic_readiness(spark, sf):
    return rank.readiness(table(spark, sf, "embeddings"), "embedding").select("total", "embedded", "missing", "ready")


def _lists(spark, sf, n=20):
    docs, emb = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    words_ = rank.ranked(text_index(spark, sf).search(Q, n, "doc_id"), "doc_id", n)
    near = rank.ranked(rank.vector_scores(emb, "embedding", _query_vector(emb)).select(F.col("vec_id").alias("doc_id"), "score"), "doc_id", n)
    longest = rank.ranked(docs.select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id", n)
    return words_, near, longest


_RANKED = f"""{BM25}, {VEC}, s AS (SELECT vec_id AS doc_id, {COS} AS score FROM v, q0),
l1 AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 20),
l2 AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20),
l3 AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents QUALIFY rank <= 20),
f AS (SELECT doc_id, l1.rank AS r1, l2.rank AS r2, 0.6 / (60 + coalesce(l1.rank, (SELECT count(*) + 1 FROM l1))) + 0.4 / (60 + coalesce(l2.rank, (SELECT count(*) + 1 FROM l2))) AS score FROM l1 FULL JOIN l2 USING (doc_id))"""


@query(f"WITH {_RANKED} SELECT doc_id, r1::INTEGER AS rank_bm25, r2::INTEGER AS rank_semantic, round(score, 8) AS score FROM f")
def rrf_two_lists(spark, sf):
    a, b, _ = _lists(spark, sf)
    return rank.fused({"bm25": a, "semantic": b}, {"bm25": 0.6, "semantic": 0.4}, "doc_id").withColumn("score", F.round("score", 8))


@query(f"""WITH {_RANKED} SELECT doc_id, round(0.5 / (60 + coalesce(l1.rank, (SELECT count(*) + 1 FROM l1))) + 0.3 / (60 + coalesce(l2.rank, (SELECT count(*) + 1 FROM l2))) + 0.2 / (60 + coalesce(l3.rank, (SELECT count(*) + 1 FROM l3))), 8) AS score
FROM l1 FULL JOIN l2 USING (doc_id) FULL JOIN l3 USING (doc_id)""")
def rrf_three_lists(spark, sf):
    a, b, c = _lists(spark, sf)
    fused = rank.fused({"bm25": a, "semantic": b, "graph": c}, {"bm25": 0.5, "semantic": 0.3, "graph": 0.2}, "doc_id")
    return fused.select("doc_id", F.round("score", 8).alias("score"))


@query(f"""WITH {BM25}, {VEC}, s AS (SELECT vec_id AS doc_id, {COS} AS score FROM v, q0 WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')),
l1 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b WHERE lang = 'en' QUALIFY rank <= 20),
l2 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20),
f AS (SELECT doc_id, 0.5 / (60 + coalesce(l1.rank, (SELECT count(*) + 1 FROM l1))) + 0.5 / (60 + coalesce(l2.rank, (SELECT count(*) + 1 FROM l2))) AS score FROM l1 FULL JOIN l2 USING (doc_id))
SELECT doc_id, round(score, 8) AS score FROM f ORDER BY f.score DESC, doc_id LIMIT 10""")
def hybrid_topk(spark, sf):
    """Tag prefilter, words and vectors, fusion; the prefilter holds for both legs."""
    docs, emb = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    tagged = rank.tags(docs.withColumn("tags", F.array("lang")), ["en"], "tags").select("doc_id")
    hits = text_index(spark, sf).scores(Q, "doc_id").join(tagged, "doc_id", "left_semi")
    near = rank.vector_scores(emb, "embedding", _query_vector(emb)).withColumnRenamed("vec_id", "doc_id").join(tagged, "doc_id", "left_semi")
    fused = rank.fused({"bm25": rank.ranked(hits, "doc_id", 20), "semantic": rank.ranked(near, "doc_id", 20)}, {"bm25": 0.5, "semantic": 0.5}, "doc_id")
    return rank.top(fused.select("doc_id", "score"), 10, "doc_id").withColumn("score", F.round("score", 8))


@query(f"""WITH {BM25}, t AS (SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 30),
r AS (SELECT t.doc_id, t.score, 0.4 + 0.4 * ((contains(lower(text), 'the'))::INT + (contains(lower(text), 'nation'))::INT + (contains(lower(text), 'with'))::INT) / 3.0::DOUBLE AS rr FROM t JOIN documents USING (doc_id))
SELECT doc_id, round(rr, 6) AS rerank_score, round(0.3 * score + 0.7 * rr, 6) AS final_score FROM r ORDER BY 0.3 * score + 0.7 * rr DESC, doc_id LIMIT 10""")
def rerank_overlap(spark, sf):
    best = text_index(spark, sf).search(Q, 30, "doc_id")
    hits = table(spark, sf, "documents").select("doc_id", "text").join(F.broadcast(best), "doc_id")  # 30 rows
    out = rank.reranked(hits, rank.overlap_score(F.col("text"), Q), 10, "doc_id")
    return _rounded(out.select("doc_id", "rerank_score", "final_score"), "rerank_score", "final_score")


@query(f"""WITH {VEC}, n AS (SELECT a.vec_id AS query_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) DESC, b.vec_id) AS r
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
c AS (SELECT query_id, label, count(*) AS c FROM n WHERE r <= 5 GROUP BY ALL),
m AS (SELECT *, max(c) OVER (PARTITION BY query_id) AS most FROM c)
SELECT query_id, most, CASE WHEN count(*) > 1 THEN 'Complex' ELSE min(label)::VARCHAR END AS label FROM m WHERE c = most GROUP BY query_id, most""")
def knn_majority_vote(spark, sf):
    """Queries are a stated set (every 50th id) against all rows."""
    emb = table(spark, sf, "embeddings")
    asked = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = matrix.best_matches(asked, emb, "query_id", "vec_id", "embedding", -2.0, 5).join(emb.select("vec_id", "label"), "vec_id")
    return rank.majority_label(near, "query_id", "label", "Complex")


_LISTS: dict[tuple[str, str], ivf.VectorIndex] = {}


def vector_index(spark, sf) -> ivf.VectorIndex:
    """Inverted lists of all vectors: built on first use in a session, opened afterwards."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _LISTS:
        _LISTS[at] = ivf.VectorIndex.build(table(spark, sf, "embeddings"), "vec_id", "embedding", f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}")
    return _LISTS[at]


@query(f"WITH {VEC} SELECT vec_id, round({COS}, 6) AS score FROM v, q0 ORDER BY {COS} DESC, vec_id LIMIT 10")
def ivf_certified(spark, sf):
    """The nearest lists, and those that could still hold a nearer row."""
    index = vector_index(spark, sf)
    return _rounded(index.certified(_query_vector(table(spark, sf, "embeddings")), "embedding", "vec_id", 10, PROBES).select("vec_id", "score"), "score")


#: Lists that a query reads: enough for a recall of 0.9 on vectors without much structure.
PROBES = 35


@query()
def ivf_recall(spark, sf):
    """One row: the share of the exact ten nearest that the probed lists give, for every 50th vector, and the share of rows read."""
    emb, index = table(spark, sf, "embeddings"), vector_index(spark, sf)
    asked = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = index.search_many(asked, "query_id", "embedding", "vec_id", 10, PROBES)
    exact = matrix.best_matches(asked, emb, "query_id", "vec_id", "embedding", -2.0, 10).select("query_id", "vec_id", F.lit(1).alias("exact"))
    recall = exact.join(near.select("query_id", "vec_id", F.lit(1).alias("found")), ["query_id", "vec_id"], "left").agg(F.count("*").alias("asked"), F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
    return recall.crossJoin(index.share_read(asked, "embedding", PROBES))  # one row each


_KIND = " ".join(f"WHEN {t} THEN '{k}'" for k, t in [("tag", "contains(lower(text), 'tag:') OR contains(lower(text), '#')"), *((k, f"regexp_matches(lower(text), '\\b({w})\\b')") for k, w in (("graph", "related|connected|linked|graph"), ("factual", "what|when|where|how many|how much"), ("conceptual", "why|explain|understand|theory"), ("recent", "recent|latest|today|yesterday|last")))])


@query(f"SELECT conv_id, turn, CASE {_KIND} ELSE 'exploratory' END AS route FROM conversations WHERE role = 'user'")
def query_route(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", rank.route(F.col("text")).alias("route"))


#: Terms at word bounds by place; of those that start first the longest, then what starts after its end.
_SPANS = r"""g(term) AS (VALUES ('the'), ('that the'), ('in'), ('of an')), b AS (SELECT item_id, text, lower(text) AS low FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item_id, text, low, unnest(range(1, length(text) + 1)) AS p FROM b),
h AS (SELECT item_id, term, p - 1 AS s, p - 1 + length(term) AS e FROM p, g WHERE starts_with(substr(low, p), term) AND NOT regexp_matches(substr(text, p - 1, CASE WHEN p > 1 THEN 1 ELSE 0 END), '[\p{L}\p{N}_]') AND NOT regexp_matches(substr(text, p + length(term), 1), '[\p{L}\p{N}_]')),
o AS (SELECT item_id, s, max(e) AS e FROM h GROUP BY ALL), z AS (SELECT item_id, 0 AS e, -1 AS s FROM b UNION ALL
  SELECT item_id, e, s FROM (SELECT o.item_id, o.e, o.s, row_number() OVER (PARTITION BY o.item_id ORDER BY o.s) AS k FROM z JOIN o ON o.item_id = z.item_id AND o.s >= z.e) WHERE k = 1)"""


@query(f"WITH RECURSIVE {_SPANS} SELECT h.item_id, h.term, h.s::INTEGER AS start, h.e::INTEGER AS end FROM z JOIN h USING (item_id, s, e)")
def glossary_terms(spark, sf):
    from larkspur.functions.text import find_terms

    rows = table(spark, sf, "benchmark").select("item_id", F.explode(find_terms(F.col("text"), ["the", "that the", "in", "of an"])).alias("m"))
    return rows.select("item_id", "m.term", "m.start", "m.end")


@query("SELECT item_id, regexp_replace(text, '(?i)\\b(that the|the|in)\\b', '**\\1**', 'g') AS highlighted FROM benchmark")
def glossary_highlight(spark, sf):
    from larkspur.functions.text import highlight_terms

    return table(spark, sf, "benchmark").select("item_id", highlight_terms(F.col("text"), ["the", "that the", "in"]).alias("highlighted"))


@query("SELECT lower(p_brand) AS term, count(*) AS parts FROM part GROUP BY 1")
def glossary_listing(spark, sf):
    return table(spark, sf, "part").groupBy(F.lower("p_brand").alias("term")).agg(F.count("*").alias("parts")).orderBy("term")


