"""Question-answer datasets over benchmark items, documents and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import entity, qa
from larkspur.plans.registry import query, table
from larkspur.plans.text import ENTITIES_SQL


@query("""WITH p AS (SELECT item_id, string_split(text, '. ') AS s FROM benchmark),
h AS (SELECT item_id, list_concat(list_transform(list_filter(list_transform(s, lambda x: trim(x)), lambda x: length(x) >= 20), lambda x: left(x, 50)), [left(s[1], 100)]) AS g FROM p)
SELECT item_id, list_sort(list_distinct(list_filter(g, lambda x: length(x) > 0))) AS segments FROM h""")
def segment_answers(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_sort(qa.segments(F.col("text"))).alias("segments"))


@query("""WITH p AS (SELECT item_id, string_split(text, '. ') AS s FROM benchmark),
h AS (SELECT item_id, unnest(list_distinct(list_concat(list_transform(list_filter(list_transform(s, lambda x: trim(x)), lambda x: length(x) >= 20), lambda x: left(x, 50)), [left(s[1], 100)]))) AS g FROM p)
SELECT item_id, 100.0::DOUBLE AS score FROM h JOIN documents ON contains(text, g) WHERE length(g) > 0 GROUP BY item_id""")
def citation_exact(spark, sf):
    """Items that some document quotes word for word; the benchmark is the small, stated side."""
    seg = table(spark, sf, "benchmark").select("item_id", F.explode(qa.segments(F.col("text"))).alias("segment"))
    return qa.quoted(seg, table(spark, sf, "documents"), "segment", "doc_id", "text").select("item_id").distinct().withColumn("score", F.lit(100.0))


@query()
def citation_validate(spark, sf):
    """Every item with the best score of its segments in any document; below 85 there is none, and it fails."""
    items = table(spark, sf, "benchmark").select("item_id", F.explode(qa.segments(F.col("text"))).alias("segment"))
    close = qa.close_quotes(items, table(spark, sf, "documents"), "segment", "text")
    best = items.join(close, "segment", "left").groupBy("item_id").agg(F.max("score").alias("score"))
    return table(spark, sf, "benchmark").select("item_id").join(best, "item_id", "left").select("item_id", F.round("score", 4).alias("score"), qa.citation_status(F.col("score")).alias("status"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|3'), doc_id) AS r, count(*) OVER () AS n FROM labels)
SELECT doc_id, CASE WHEN r <= n - floor(n * 0.1)::BIGINT - floor(n * 0.1)::BIGINT THEN 'train' WHEN r <= n - floor(n * 0.1)::BIGINT THEN 'validation' ELSE 'test' END AS split FROM r""")
def split_counts(spark, sf):
    return qa.split(table(spark, sf, "labels").select("doc_id"), "doc_id", {"train": 0.8, "validation": 0.1, "test": 0.1}, 3)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|3'), doc_id) AS r, count(*) OVER () AS n FROM labels)
SELECT doc_id, CASE WHEN r <= floor(n * 0.8)::BIGINT THEN 'train' WHEN r <= floor(n * 0.8)::BIGINT + floor(n * 0.1)::BIGINT THEN 'validation' ELSE 'test' END AS split FROM r""")
def split_remainder_test(spark, sf):
    return qa.split(table(spark, sf, "labels").select("doc_id"), "doc_id", {"train": 0.8, "validation": 0.1, "test": 0.1}, 3, "test")


@query("WITH t AS (SELECT c_mktsegment AS type, count(*) / (SELECT count(*) FROM customer) AS share FROM customer GROUP BY 1), b AS (SELECT type, share, floor(share * 97)::BIGINT AS n FROM t) SELECT type, n + (row_number() OVER (ORDER BY type) <= 97 - (SELECT sum(n) FROM b))::INT AS n FROM b")
def type_allocation(spark, sf):
    c = table(spark, sf, "customer")
    t = c.groupBy(F.col("c_mktsegment").alias("type")).agg(F.count("*").alias("k")).crossJoin(c.agg(F.count("*").alias("all")))
    return qa.allocated(t.select("type", (F.col("k") / F.col("all")).alias("share")), 97).select("type", "n")


@query("SELECT source, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS valid, round(avg(n_chars), 6) AS average, round(count(*) FILTER (WHERE quality = 1) / count(*), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def qa_stats(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("ok", F.col("quality") == 1)
    return qa.statistics(rows, "source", "ok", "n_chars").withColumns({"average": F.round("average", 6), "rate": F.round("rate", 6)})


def _pairs(spark, sf):
    conv = table(spark, sf, "conversations")
    q = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


_P = "p AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"


@query(f"WITH {_P} SELECT conv_id, turn, 3 AS messages, md5('Context: ' || conv_id) AS lead, md5(answer) AS last FROM p")
def chat_export(spark, sf):
    rows = qa.chat(_pairs(spark, sf).withColumn("context", F.col("conv_id").cast("string")), "question", "answer", "context")
    return rows.select("conv_id", "turn", F.size("messages").alias("messages"), F.md5(F.col("messages")[0]["content"]).alias("lead"), F.md5(F.element_at("messages", -1)["content"]).alias("last"))


@query(f"WITH {_P} SELECT md5(question) AS instruction, '' AS input, md5(answer) AS output FROM p")
def instruction_export(spark, sf):
    return qa.instruction(_pairs(spark, sf), "question", "answer").select(F.md5("instruction").alias("instruction"), "input", F.md5("output").alias("output"))


@query(f"WITH {_P} SELECT conv_id, turn, trim(question) <> '' AND length(trim(answer)) BETWEEN 10 AND 10000 AS ok FROM p")
def reply_checks(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", qa.reply_ok(F.col("question"), F.col("answer")).alias("ok"))


@query(rf"""WITH {_P}, q AS (SELECT *, trim(regexp_replace(question, '\?+$', '')) AS q, trim(answer) AS a FROM p),
x AS (SELECT *, left(a, 80) AS s, regexp_extract(q, '(?i)^what (?:is|are) (?:the |an? )?(.+)$', 1) AS what, regexp_extract(q, '(?i)^who (.+)$', 1) AS who, regexp_extract(q, '(?i)^where (?:is|are) (.+)$', 1) AS place, CASE WHEN starts_with(lower(q), 'how') THEN '' ELSE coalesce(regexp_extract_all(q, '(?:^|[^\p{{L}}\p{{N}}_])(\p{{Lu}}[\p{{L}}\p{{N}}_]+(?: \p{{Lu}}[\p{{L}}\p{{N}}_]+)*)', 1)[-1], '') END AS name FROM q)
SELECT conv_id, turn, md5(CASE WHEN what <> '' THEN 'What is described as: ' || s || '?' WHEN who <> '' THEN 'What did ' || s || ' do?' WHEN place <> '' THEN 'What is found in ' || s || '?' WHEN name <> '' THEN 'What is ' || s || ' related to?' ELSE 'Which question is answered by: ' || s || '?' END) AS question,
md5(CASE WHEN what <> '' THEN what WHEN who <> '' THEN who WHEN place <> '' THEN place WHEN name <> '' THEN name ELSE question END) AS answer, 0.72::DOUBLE AS reversed_confidence FROM x""")
def reversals(spark, sf):
    rows = qa.reversed_pairs(_pairs(spark, sf).withColumn("confidence", F.lit(0.8)), "question", "answer", "confidence")
    return rows.select("conv_id", "turn", F.md5("reversed_question").alias("question"), F.md5("reversed_answer").alias("answer"), "reversed_confidence")


@query("SELECT event_id, round(CASE event_type WHEN 'click' THEN 0.8 WHEN 'view' THEN 0.5 WHEN 'purchase' THEN 0.9 WHEN 'error' THEN 0.6 ELSE 0.7 END * value / 100, 6)::DOUBLE AS weight FROM events")
def edge_weights(spark, sf):
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in {"click": "RELATIONSHIP", "view": "REVERSAL", "purchase": "FACTUAL", "error": "MULTI_HOP"}.items() for x in kv)), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", F.round(qa.weight(F.coalesce(kind, F.lit("HIERARCHICAL")), F.col("value") / 100), 6).alias("weight"))


@query("""SELECT event_id, round(least(1, greatest(0, CASE WHEN event_id % 7 = 0 THEN 0.7 ELSE value / 100 END + 0.1 * least(event_id % 5 / 3.0::DOUBLE, 1) + CASE event_id % 3 WHEN 0 THEN 0.15 WHEN 1 THEN -0.2 ELSE 0 END + CASE WHEN event_id % 4 = 0 THEN 0.05 ELSE 0 END)), 6)::DOUBLE AS context FROM events""")
def context_confidence(spark, sf):
    i = F.col("event_id")
    base, cited = F.when(i % 7 != 0, F.col("value") / 100), F.when(i % 3 == 0, True).when(i % 3 == 1, False)
    return table(spark, sf, "events").select("event_id", F.round(qa.context_confidence(base, i % 5, cited, i % 4 == 0), 6).alias("context"))


@query(f"""WITH {ENTITIES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, name) AS r FROM en), e AS (SELECT a.doc_id, a.name AS src, b.name AS dst, 0.95::DOUBLE * a.confidence * b.confidence AS c FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.r = 1 AND b.r = 2)
SELECT doc_id, src, dst, round(c, 6) AS edge_confidence, CASE WHEN c >= 0.7 THEN 'auto_approved' ELSE 'pending' END AS review_status FROM e""")
def qa_edges(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(0.95).alias("confidence"))
    found = entity.entities(docs, "doc_id", "text")
    return qa.edges(docs.drop("text"), found, "doc_id", "confidence").select("doc_id", "src", "dst", F.round("edge_confidence", 6).alias("edge_confidence"), "review_status")


def _html_blocks(spark, sf):
    """Headings and paragraphs of pages as blocks of one-page documents."""
    tags = F.regexp_extract_all("html", F.lit(r"(?s)<(h[1-5]|p)[^>]*>"), F.lit(1))
    rows = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.lit(0).alias("page"), F.posexplode(tags).alias("idx", "tag"))
    return rows.select("document_id", "page", "idx", F.when(F.col("tag") == "p", "text").otherwise("heading").alias("type"), F.when(F.col("tag") != "p", F.substring("tag", 2, 1).cast("int")).alias("level"))


@query("SELECT page_id::VARCHAR AS document_id, count(*) AS blocks FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(h[1-5]|p)[^>]*>', 1)) AS tag FROM pages) GROUP BY 1")
def html_blocks(spark, sf):
    return _html_blocks(spark, sf).groupBy("document_id").agg(F.count("*").alias("blocks"))


_B = """b0 AS (SELECT page_id::VARCHAR AS d, regexp_extract_all(html, '(?s)<(h[1-5]|p)[^>]*>', 1) AS t FROM pages), b AS (SELECT d, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS idx FROM b0),
h AS (SELECT *, CASE WHEN tag <> 'p' THEN substr(tag, 2, 1)::INT END AS level FROM b)"""


@query(f"""WITH {_B}, nx AS (SELECT d || ':0:' || lag(idx) OVER (PARTITION BY d ORDER BY idx) AS source, d || ':0:' || idx AS target FROM h),
ct AS (SELECT d || ':0:' || (SELECT max(g.idx) FROM h g WHERE g.d = h.d AND g.level IS NOT NULL AND g.idx < h.idx) AS source, d || ':0:' || idx AS target FROM h WHERE level IS NULL),
pc AS (SELECT d || ':0:' || (SELECT max(g.idx) FROM h g WHERE g.d = h.d AND g.level < h.level AND g.idx < h.idx) AS source, d || ':0:' || idx AS target FROM h WHERE level IS NOT NULL)
SELECT source, target, 'NEXT_IN_SEQUENCE' AS type FROM nx WHERE source IS NOT NULL UNION ALL SELECT source, target, 'CONTAINS' FROM ct WHERE source IS NOT NULL UNION ALL SELECT source, target, 'PARENT_CHILD' FROM pc WHERE source IS NOT NULL""")
def block_sequence(spark, sf):
    return qa.block_relations(_html_blocks(spark, sf))


