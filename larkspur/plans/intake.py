"""Enriched matrices, analyses, captions, chunks with lines, texts to cite from, and what limiters have left."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as t
from larkspur.operators import qa, risk
from larkspur.plans.registry import query, table
from larkspur.plans.risk import _T, _techniques
from larkspur.streaming import jobs


@query(f"WITH {_T} SELECT id, risk AS risk_score, round(100 * im, 6) AS impact_score, round(100 * lk, 6) AS likelihood_score, round(100 * dt, 6) AS detection_score, CASE WHEN cm > 0 THEN least(100.0, 20.0 * cm) ELSE 10.0 END::DOUBLE AS mitigation_effectiveness FROM x")
def threat_heatmap(spark, sf):
    rounded = (F.round(c, 6).alias(c) for c in ("impact_score", "likelihood_score", "detection_score"))
    return risk.threat_metrics(_techniques(spark, sf)).select("id", "risk_score", *rounded, "mitigation_effectiveness")


@query("""WITH a AS (SELECT p_partkey AS src, CASE WHEN p_size % 4 = 0 THEN [] ELSE ['T' || (p_size % 7), 'T' || (p_size % 5)] END AS ids, CASE WHEN p_size % 3 > 0 THEN p_size / 50 END AS s FROM part)
SELECT src, unnest(ids) AS dst, round(coalesce(s, 0), 6)::DOUBLE AS confidence FROM a""")
def detected_edges(spark, sf):
    """Parts as analyses: each fourth names no technique, each third has no score."""
    size, name = F.col("p_size"), lambda n: F.concat(F.lit("T"), (F.col("p_size") % n).cast("string"))
    named = F.when(size % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(name(7), name(5)))
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), named.alias("ids"), F.when(size % 3 > 0, size / 50).alias("score"))
    return risk.detected_in(a, "id", "ids", "score").withColumn("confidence", F.round("confidence", 6))


@query("SELECT conv_id, turn, md5(text) AS hash FROM conversations WHERE turn % 6 < 4 AND text IS NOT NULL")
def citation_corpus(spark, sf):
    """Turns as objects of six kinds, of which four are cited from."""
    kinds = F.array(*map(F.lit, [*qa.CORPUS_KINDS, "figure", "footer"]))
    o = table(spark, sf, "conversations").withColumn("type", F.get(kinds, (F.col("turn") % 6).cast("int")))
    return qa.corpus(o).select("conv_id", "turn", F.md5("text").alias("hash"))


@query("SELECT doc_id, nullif(regexp_extract(text, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS number FROM documents")
def caption_numbers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.first_number(F.col("text")).alias("number"))


@query("SELECT doc_id, doc_id % 9 + 1 AS first_line, doc_id % 9 + 1 + length(text) - length(replace(text, chr(10), '')) AS last_line, length(text) // 4 AS content_tokens, length(source) // 4 AS title_tokens, sha256(text) AS section_id FROM documents WHERE text IS NOT NULL")
def chunk_lines(spark, sf):
    rows = table(spark, sf, "documents").withColumn("line", F.col("doc_id") % 9 + 1)
    return t.chunk_records(rows, "text", "source", "line").select("doc_id", "first_line", "last_line", "content_tokens", "title_tokens", "section_id")


@query("""SELECT user_id, count(*) FILTER (WHERE l) AS current_calls, 20 - count(*) FILTER (WHERE l) AS available_capacity
FROM (SELECT user_id, event_type <> 'error' AND ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-15' AS l FROM events) GROUP BY 1""")
def limiter_capacity(spark, sf):
    """Calls of all types but errors as admitted ones; 20 calls in five days."""
    rows = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("admitted"))
    return jobs.limiter_stats(rows, "user_id", "ts", F.lit("2024-01-15").cast("timestamp"), 20 / 432_000, 20)


#: Turns as blocks of a conversation's document: each fifth is a captioned table or figure, the others may name one.
_BLOCKS = r"""b AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'image' ELSE 'text' END AS kind, (turn // 5)::VARCHAR || '.' || (conv_id % 3)::VARCHAR AS n FROM conversations),
c AS (SELECT conv_id, CASE kind WHEN 'table' THEN 'table' ELSE 'figure' END AS kind, n, max(turn) AS turn FROM b WHERE kind <> 'text' AND (conv_id + turn) % 4 > 0 GROUP BY ALL),
m AS (SELECT DISTINCT conv_id, turn, unnest([{'kind': 'table', 'n': '0.' || (turn % 3)::VARCHAR}, {'kind': 'figure', 'n': '0.' || (conv_id % 2)::VARCHAR}, {'kind': 'figure', 'n': '1'}]) AS m FROM b WHERE kind = 'text')"""


@query(f"WITH {_BLOCKS} SELECT m.conv_id || ':1:' || m.turn AS source, c.conv_id || ':1:' || c.turn AS target, 'REFERENCES' AS type, c.kind AS reference_type FROM m JOIN c ON c.conv_id = m.conv_id AND c.kind = m.m.kind AND c.n = m.m.n")
def block_references(spark, sf):
    """Planted captions ("Table 0.1: ...", each fourth without its kind) and mentions in three spellings; `Fig. 1` names none."""
    kind = F.element_at(F.array(*map(F.lit, ["table", "image", "text", "text", "text"])), (F.col("turn") % 5 + 1).cast("int"))
    number = F.concat_ws(".", F.floor(F.col("turn") / 5).cast("string"), (F.col("conv_id") % 3).cast("string"))
    name = F.when(kind == "table", "Table ").otherwise("Figure ")
    caption = F.when(kind != "text", F.concat(F.when((F.col("conv_id") + F.col("turn")) % 4 > 0, name).otherwise("No. "), number, F.lit(": of 7")))
    said = F.concat(F.lit("As TAB. 0."), (F.col("turn") % 3).cast("string"), F.lit(" and figure 0."), (F.col("conv_id") % 2).cast("string"), F.lit(" show, see Fig 1; not xfig 0.0, table  0.1 or table 0.15. "), F.coalesce("text", F.lit("")))
    blocks = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.lit(1).alias("page"), F.col("turn").alias("idx"), kind.alias("type"), said.alias("text"), caption.alias("caption"))
    return qa.block_references(blocks)
