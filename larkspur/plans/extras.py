"""Routed and graph-expanded search, QA-edge search, dashboards, message versions and shapes of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import vector
from larkspur.operators import dashboard, search
from larkspur.plans.registry import query, table
from larkspur.plans.retrieval import BM25, COS, TOKENS, VEC, _query_vector, text_index
from larkspur.sources import messages


def _docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.array("lang", "source").alias("tags"), F.col("source"))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return d, v


def _words_sql(rows: str, words: list[str]) -> str:
    """b (key, score): BM25 of rows (key, w) for words, as the operator scores them."""
    asked = ", ".join(f"('{w}')" for w in words)
    return f"""d AS ({rows}), st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)::DOUBLE) AS a FROM d), q(t) AS (VALUES {asked}), df AS (SELECT t, count(*)::DOUBLE AS df FROM q JOIN d ON list_contains(w, t) GROUP BY t),
b AS (SELECT key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / a))) AS score FROM (SELECT d.*, df.df, len(list_filter(w, lambda x: x = t))::DOUBLE AS tf FROM d JOIN df ON list_contains(w, t)), st GROUP BY key)"""


_WHY = _words_sql(f"SELECT doc_id AS key, text, {TOKENS} AS w FROM documents", ["why", "the", "nation", "of", "with"])
_HELD = " + ".join(f"(contains(lower(text), '{w}'))::INT" for w in ("why", "the", "nation", "with"))


@query(f"""WITH {_WHY}, {VEC}, l1 AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS r FROM b QUALIFY r <= 20), s AS (SELECT vec_id AS key, {COS} AS score FROM v, q0 WHERE vec_id IN (SELECT key FROM d)),
l2 AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS r FROM s QUALIFY r <= 20),
f AS (SELECT key, 0.3 / (60 + coalesce(l1.r, (SELECT count(*) + 1 FROM l1))) + 0.7 / (60 + coalesce(l2.r, (SELECT count(*) + 1 FROM l2))) AS score FROM l1 FULL JOIN l2 USING (key) ORDER BY score DESC, key LIMIT 20)
SELECT key AS doc_id, round(0.3 * score + 0.7 * (0.4 + 0.4 * ({_HELD}) / 4.0::DOUBLE), 8) AS score FROM f JOIN d USING (key) ORDER BY 0.3 * score + 0.7 * (0.4 + 0.4 * ({_HELD}) / 4.0::DOUBLE) DESC, key LIMIT 10""")
def routed_search(spark, sf):
    """A question of reasons: words and vectors, reranked."""
    d, v = _docs(spark, sf)
    out = search.routed(d, "doc_id", "text", "why the nation of with", vectors=v, vector=_query_vector(table(spark, sf, "embeddings")), index=text_index(spark, sf))
    return out.withColumn("score", F.round("score", 8))


@query(f"""WITH {BM25}, l1 AS (SELECT doc_id, source, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b QUALIFY r <= 20),
g AS (SELECT doc_id, score FROM l1 UNION ALL SELECT -1 - regexp_extract(source, '[0-9]+$')::BIGINT, 0.8 * score FROM l1), m AS (SELECT doc_id, max(score) AS score FROM g GROUP BY 1),
l2 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM m QUALIFY r <= 20)
SELECT doc_id, round(0.4 / (60 + coalesce(l1.r, (SELECT count(*) + 1 FROM l1))) + 0.6 / (60 + coalesce(l2.r, (SELECT count(*) + 1 FROM l2))), 8) AS score FROM l1 FULL JOIN l2 USING (doc_id)
ORDER BY 0.4 / (60 + coalesce(l1.r, (SELECT count(*) + 1 FROM l1))) + 0.6 / (60 + coalesce(l2.r, (SELECT count(*) + 1 FROM l2))) DESC, doc_id LIMIT 10""")
def graph_rag(spark, sf):
    """Seeds by words, and the sources that they lead to, as vertices of their own."""
    d, _ = _docs(spark, sf)
    e = d.select(F.col("doc_id").alias("src"), (-1 - F.regexp_extract("source", "[0-9]+$", 0).cast("long")).alias("dst"))
    plan = search.Plan({"bm25": 0.4, "graph": 0.6})
    return search.hybrid(d, "doc_id", "text", "the nation of with", plan, edges=e, index=text_index(spark, sf)).withColumn("score", F.round("score", 8))


_MEMORY = _words_sql(f"SELECT conv_id * 1000 + turn AS key, {TOKENS} AS w FROM conversations WHERE conv_id = 5", ["the", "of", "und", "die", "de", "la", "en", "el"])


@query(f"WITH {_MEMORY} SELECT key, round(score, 6) AS score FROM b ORDER BY b.score DESC, key LIMIT 10")
def memory_search(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.col("conv_id").alias("conversation_id"), F.col("text").alias("content"))
    return search.memories(c, "key", "the of und die de la en el", None, 10, conversation=5).select("key", F.round("score", 6).alias("score"))


@query(f"WITH {VEC} SELECT vec_id, round({COS}, 6) AS score FROM v, q0 WHERE label < 5 AND {COS} >= 0.2 ORDER BY {COS} DESC, vec_id LIMIT 5")
def compaction_search(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("compaction_method", F.when(F.col("label") < 5, "extract").otherwise("summary"))
    return search.compactions(e, "vec_id", _query_vector(e), 5, 0.2, ["extract"]).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {VEC}, s AS (SELECT vec_id, {COS} AS score FROM v, q0) SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.75 ORDER BY s.score DESC, vec_id LIMIT 5")
def compaction_default(spark, sf):
    """The same of all methods, at the floor that holds by default."""
    e = table(spark, sf, "embeddings")
    return search.compactions(e, "vec_id", _query_vector(e)).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {VEC} SELECT vec_id AS key, round(({COS} + 1) / 2, 6) AS score FROM v, q0 ORDER BY {COS} DESC, vec_id LIMIT 10")
def memory_vector(spark, sf):
    """Memories without a filter go by vector."""
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "key")
    asked = _query_vector(e.withColumnRenamed("key", "vec_id"))
    return search.memories(e, "key", "anything", asked).select("key", F.round("score", 6).alias("score"))


_ASKED = _words_sql(f"SELECT q.conv_id * 1000 + q.turn AS key, list_concat({TOKENS.replace('text', 'q.text')}, {TOKENS.replace('text', 'a.text')}) AS w, lower(coalesce(q.text, '')) AS question, lower(coalesce(a.text, '')) AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'", ["the", "and", "of"])
_HOLDS = "contains({0}, 'the') OR contains({0}, 'and') OR contains({0}, 'of')"


@query(f"WITH {_ASKED}, z AS (SELECT key, 10 * score + CASE WHEN {_HOLDS.format('question')} THEN 2 ELSE 0 END + CASE WHEN {_HOLDS.format('answer')} THEN 3 ELSE 0 END AS score FROM b JOIN d USING (key)) SELECT key, round(score, 6) AS score FROM z ORDER BY z.score DESC, key LIMIT 10")
def qa_edge_search(spark, sf):
    conv = table(spark, sf, "conversations")
    q = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    e = q.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "question", "answer", F.lit(0.9).alias("confidence"))
    return search.qa_edges(e, "the and of", "key", 10).select("key", F.round("score", 6).alias("score"))


_W = "w AS (SELECT o_custkey AS d, o_orderkey AS id, o_orderkey % 10 AS x, o_orderkey % 7 AS y, 2 AS w, 2 AS h FROM orders)"


def _widgets(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("d"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 10).alias("x"), (F.col("o_orderkey") % 7).alias("y"), F.lit(2).alias("w"), F.lit(2).alias("h"))


@query(f"WITH {_W} SELECT a.d, a.id AS one, b.id AS two FROM w a JOIN w b ON a.d = b.d AND a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def widget_collisions(spark, sf):
    return dashboard.collisions(_widgets(spark, sf), "d")


@query(f"WITH {_W}, s AS (SELECT d, y, x FROM (SELECT DISTINCT d FROM w), range(0, 19) a(y), range(0, 11) b(x)), f AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.d = s.d AND s.x < w.x + w.w AND w.x < s.x + 2 AND s.y < w.y + w.h AND w.y < s.y + 2)) SELECT d, x::INTEGER AS x, y::INTEGER AS y FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY y, x) AS r FROM f) WHERE r = 1")
def widget_first_free(spark, sf):
    return dashboard.first_free(_widgets(spark, sf), "d", 2, 2, 12, 20)


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = 3 UNION SELECT s_suppkey FROM supplier WHERE false")
def dashboard_list(spark, sf):
    d = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("owner"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    return dashboard.visible(d, "3", ["b", "z"]).select("id")


@query("SELECT conv_id, turn, '2.1' AS version, role AS type, md5(text) AS hash, 'normal' AS priority FROM conversations")
def message_migration(spark, sf):
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.col("text").alias("content"))
    return messages.migrated(m, "1.0", "2.1").select("conv_id", "turn", "version", "type", F.md5("content.text").alias("hash"), "content.priority")


@query("SELECT conv_id, turn, '1.0' AS version, role AS kind, md5(text) AS hash FROM conversations")
def message_downgrade(spark, sf):
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.col("text").alias("content"))
    return messages.migrated(messages.migrated(m, "1.0", "2.1"), "2.1", "1.0").select("conv_id", "turn", "version", "kind", F.md5("content").alias("hash"))


@query("SELECT 'o_orderkey' AS name, 'number' AS kind UNION ALL SELECT 'o_custkey', 'number' UNION ALL SELECT 'o_orderstatus', 'string' UNION ALL SELECT 'o_totalprice', 'number' UNION ALL SELECT 'o_orderdate', 'date' UNION ALL SELECT 'o_orderpriority', 'string'")
def column_kinds(spark, sf):
    return spark.createDataFrame(list(messages.column_kinds(table(spark, sf, "orders")).items()), "name string, kind string")


@query("SELECT n, CASE WHEN n < 100 THEN least(2, n) WHEN n < 1000 THEN 10 ELSE 50 END AS lists FROM (SELECT label, count(*) * 7 AS n FROM embeddings GROUP BY 1)")
def index_lists(spark, sf):
    n = table(spark, sf, "embeddings").groupBy("label").agg((F.count("*") * 7).alias("n"))
    return n.select("n", vector.index_lists(F.col("n")).alias("lists"))
