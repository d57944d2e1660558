"""Imports and exports through files, changes of single rows, logs, dates, repairs, and entities of several extractors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspur.functions import text as t
from larkspur.functions import vector
from larkspur.operators import conversation, entity, graph, qa, rank, temporal
from larkspur.plans import temporal as temporal_plans
from larkspur.plans.qa import _P, _pairs
from larkspur.plans.registry import query, table
from larkspur.plans.retrieval import COS, VEC, _query_vector
from larkspur.plans.temporal import PAIRS
from larkspur.sources import files, records, store
from larkspur.sources.shared import shared_dir


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'k' || c_custkey END AS own_key, CASE WHEN c_custkey % 3 > 0 THEN length('k' || c_custkey) ELSE 36 END AS key_length, c_custkey % 2 = 0 AS own_time FROM customer")
def insert_documents(spark, sf):
    """Rows of which each third has no key and each other no time."""
    key, long_ago = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("k"), F.col("c_custkey").cast("string"))), F.lit("2020-01-01").cast("timestamp")
    rows = table(spark, sf, "customer").select("c_custkey", key.alias("key"), F.when(F.col("c_custkey") % 2 == 0, long_ago).alias("created_at"))
    made = store.created(rows)
    return made.select("c_custkey", F.when(F.col("key").startswith("k"), F.col("key")).alias("own_key"), F.length("key").cast("long").alias("key_length"), (F.col("created_at") == long_ago).alias("own_time"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_documents(spark, sf):
    gone = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return store.deleted(table(spark, sf, "orders"), gone, "o_custkey").select("o_orderkey")


@query("SELECT conv_id::VARCHAR AS conversation, role, md5(text) AS hash FROM conversations")
def records_roundtrip(spark, sf):
    """Conversations as files of JSON lines, read again by the library's data source."""
    records.register(spark)
    folder = _folder(spark, "records")
    table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("conversation_id"), "role", F.col("text").alias("content")).write.json(folder)
    return spark.read.format("larkspur_records").option("split", 1 << 20).load(folder).select("conversation", "role", F.md5("content").alias("hash"))


@query("SELECT 't' || p_partkey AS id, unnest(['a' || (p_size % 5), 'a' || (p_size % 3)]) AS tactic_id, p_brand AS severity FROM part")
def technique_import(spark, sf):
    """Parts as techniques of two tactics, imported from JSON: one row a technique and tactic."""
    p, folder = table(spark, sf, "part"), _folder(spark, "techniques")
    tactic = lambda n: F.concat(F.lit("a"), (F.col("p_size") % n).cast("string"))
    one = F.struct(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("severity"), F.array(tactic(5), tactic(3)).alias("tactic_ids"))
    p.select(F.array(one).alias("techniques")).write.json(folder)
    return files.techniques(spark, folder, lines=True).select("id", "tactic_id", "severity")


def _examples(spark, sf):
    turn = lambda role, c, thinking: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"), thinking.alias("thinking"))
    kind = F.when(F.col("turn") % 4 == 0, "FACTUAL").otherwise("MULTI_HOP")
    meta = F.struct(kind.alias("question_type"), (F.col("turn") % 10 / 10).alias("confidence"), F.lit(0.5).alias("validation_score"), (F.col("conv_id") % 2 == 0).alias("citation_found"), F.col("conv_id").cast("string").alias("document_id"), F.lit("2024-01-01").alias("created_at"))
    thought = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(' so, "it"\n'), F.col("turn").cast("string")))
    return _pairs(spark, sf).select(F.array(turn("user", "question", F.lit(None).cast("string")), turn("assistant", "answer", thought)).alias("messages"), meta.alias("metadata"))


_FLAT = f"""WITH {_P}, x AS (SELECT md5(question) AS question, md5(answer) AS answer, CASE WHEN turn % 3 = 0 THEN ' so, "it"' || chr(10) || turn ELSE '' END AS thinking, CASE WHEN turn % 4 = 0 THEN 'FACTUAL' ELSE 'MULTI_HOP' END AS question_type,
  round(turn % 10 / 10, 6)::DOUBLE AS confidence, 0.5::DOUBLE AS validation_score, conv_id % 2 = 0 AS citation_found, conv_id::VARCHAR AS document_id, '2024-01-01' AS created_at FROM p) SELECT"""


def _hashed(df):
    return df.withColumns({"question": F.md5("question"), "answer": F.md5("answer"), "confidence": F.round("confidence", 6)})


@query(f"{_FLAT} * EXCLUDE (document_id, created_at) FROM x")
def export_csv_gzip(spark, sf):
    """Training examples in seven columns, as compressed CSV and read again: breaks, quotes and empty texts stay."""
    folder = _folder(spark, "csv")
    files.write(qa.tabular(_examples(spark, sf), qa.CSV_COLUMNS), folder, "csv", "gzip")
    return _hashed(files.csv(spark, folder, "question string, answer string, thinking string, question_type string, confidence double, validation_score double, citation_found boolean"))


@query(f"{_FLAT} * FROM x")
def export_parquet(spark, sf):
    """The same in nine columns, as Parquet."""
    folder = _folder(spark, "parquet")
    files.write(qa.tabular(_examples(spark, sf)), folder, "parquet")
    return _hashed(spark.read.parquet(folder))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, epoch_us(ts - INTERVAL 45 DAY) AS earlier_us, epoch_us(ts + INTERVAL 1 MONTH) AS later_us FROM events")
def date_functions(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", temporal.iso8601(ts).alias("iso"), F.unix_micros(temporal.shifted(ts, -45, "days")).alias("earlier_us"), F.unix_micros(temporal.shifted(ts, 1, "month")).alias("later_us"))


@query("""SELECT event_id, epoch_us(CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '2024-06-01' ELSE date_trunc('second', ts) END) AS start_us, CASE WHEN event_id % 5 > 0 THEN epoch_us(TIMESTAMP '2025-01-01 10:00:00') END AS end_us,
CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, 'users/' || user_id AS source_id, user_id::VARCHAR AS source_key FROM events""")
def edge_decoration(spark, sf):
    """Events as edges: each seventh start and each fifth end is no time, and each other edge has no confidence."""
    e, key = table(spark, sf, "events"), F.col("user_id").cast("string")
    rows = e.select("event_id", "user_id", F.when(F.col("event_id") % 7 == 0, "yesterday").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("from"), F.when(F.col("event_id") % 5 == 0, "12/31/2024").otherwise("2025-01-01T12:00:00+02:00").alias("until"), F.when(F.col("event_id") % 2 == 0, 0.5).alias("confidence"))
    made = temporal.decorated(rows, F.col("from"), F.col("until"), F.lit("2024-06-01").cast("timestamp"), F.struct(F.concat(F.lit("users/"), key).alias("id"), key.alias("key")))
    return made.select("event_id", F.unix_micros("valid_at").alias("start_us"), F.unix_micros("invalid_at").alias("end_us"), "confidence", "source_id", "source_key")


@query("SELECT 'compactions/' || conv_id AS src, 'messages/' || conv_id || '-' || turn AS dst, 'summarizes' AS type FROM conversations")
def compaction_edges(spark, sf):
    conv = table(spark, sf, "conversations")
    done = conversation.compactions(conv, "conv_id", "turn", "role", "text").select("conv_id", F.concat(F.lit("compactions/"), F.col("conv_id").cast("string")).alias("key"))
    messages = conv.select("conv_id", F.concat(F.lit("messages/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("message"))
    return conversation.compaction_edges(done, messages, "conv_id", "key", "message").select("src", "dst", "type")


@query("""WITH v AS (SELECT DISTINCT 's' || l_suppkey AS id FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey FROM lineitem), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM v)
SELECT DISTINCT a.i AS source_index, b.i AS target_index FROM lineitem JOIN n a ON a.id = 's' || l_suppkey JOIN n b ON b.id = 'p' || l_partkey""")
def link_indexes(spark, sf):
    from larkspur.plans.graph import _plain, _vertices

    links = _plain(spark, sf).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return graph.indexed_links(graph.numbered(_vertices(spark, sf)), links).select("source_index", "target_index")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents JOIN labels USING (doc_id))
SELECT source AS kind, count(*) AS total, round(count(*) / max(n), 6) AS share, count(*) FILTER (WHERE quality = 1) AS valid, round(count(*) FILTER (WHERE quality = 1) / count(*), 6) AS valid_share, round(avg(n_chars), 6) AS average, min(doc_id) AS sample_id, max(CASE WHEN r = 1 THEN md5(text) END) AS sample_hash FROM p GROUP BY 1""")
def qa_summary(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("ok", F.col("quality") == 1)
    out = qa.summary(rows, "source", "ok", "n_chars", "doc_id", ["doc_id", "text"])
    return out.select("kind", "total", F.round("share", 6).alias("share"), "valid", F.round("valid_share", 6).alias("valid_share"), F.round("average", 6).alias("average"), F.col("sample.doc_id").alias("sample_id"), F.md5("sample.text").alias("sample_hash"))


@query(f"WITH {VEC}, s AS (SELECT vec_id, {COS} AS score FROM v, q0) SELECT vec_id, round(1 - score, 6) AS distance FROM s WHERE score >= 0.5 ORDER BY 1 - s.score, vec_id LIMIT 10")
def vector_distances(spark, sf):
    emb = table(spark, sf, "embeddings")
    return rank.vector_distances(emb, "embedding", _query_vector(emb), 10, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' WHEN 3 THEN 'number' WHEN 4 THEN 'boolean' ELSE 'null' END AS kind, event_id % 6 = 1 AS is_list FROM events""")
def attribute_kinds(spark, sf):
    """Attributes of six kinds made of the events' properties."""
    made = F.element_at(F.array(F.col("props"), F.concat(F.lit(" ["), F.col("props"), F.lit("]")), F.lit('"x"'), F.lit("-1.5e3"), F.lit("true"), F.lit("null")), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", t.json_kind(made).alias("kind"))
    return rows.withColumn("is_list", F.col("kind") == "array")


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN CASE WHEN vec_id % 3 = 0 THEN 'made from content' WHEN vec_id % 3 = 1 THEN 'made from title' ELSE 'missing' END WHEN vec_id % 5 = 1 THEN 'cut' WHEN vec_id % 5 = 2 THEN 'padded' ELSE 'kept' END AS how,
CASE WHEN vec_id % 5 = 0 AND vec_id % 3 = 2 THEN NULL ELSE 64 END AS size,
CASE WHEN vec_id % 5 = 0 THEN CASE WHEN vec_id % 3 < 2 THEN 1.0 END ELSE round(sqrt(list_sum(list_transform(CASE WHEN vec_id % 5 = 2 THEN embedding[1:60] ELSE embedding END, lambda x: x::DOUBLE * x::DOUBLE))), 4) END::DOUBLE AS norm FROM embeddings""")
def embedding_repair(spark, sf):
    """Vectors of which some are missing, four too long, or four too short; made ones have length one."""
    v = vector.doubles(F.col("embedding"))
    damaged = F.when(F.col("vec_id") % 5 == 0, None).when(F.col("vec_id") % 5 == 1, F.concat(v, F.slice(v, 1, 4))).when(F.col("vec_id") % 5 == 2, F.slice(v, 1, 60)).otherwise(v)
    name = F.col("vec_id").cast("string")
    fields = {"content": F.when(F.col("vec_id") % 3 == 0, name), "title": F.when(F.col("vec_id") % 3 == 1, name).otherwise(" ")}
    new, how = vector.repaired(damaged, 64, fields)
    rows = table(spark, sf, "embeddings").select("vec_id", how.alias("how"), new.alias("v"))
    return rows.select("vec_id", "how", F.when(F.col("v").isNotNull(), F.size("v")).alias("size"), F.round(vector.norm(F.col("v")), 4).alias("norm"))


@query("""WITH d AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, k, CASE WHEN event_id % 8 IN (0, 1, 2, 4, 5, 7) THEN 'it''s {ok}, x: 1' END AS s, CASE WHEN event_id % 8 IN (3, 5) THEN true END AS b FROM d""")
def json_repair(spark, sf):
    """Events as replies with faults that models make: fences, bare keys, Python's words, missing ends, single quotes, comments."""
    k, s = F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), "\"it's {ok}, x: 1\""
    shapes = [
        ("```json\n{\"k\": ", f", \"s\": {s}}}\n```"), ("{k: ", f", s: {s},}}"), ("Here: {\"k\": ", f", \"s\": {s}"), ("{'k': ", ", 'b': True, 's': None}"),
        ("As asked, {\"k\": ", f", \"s\": {s}, // why\n}}"), ("{\"b\": true, \"k\": ", f", \"s\": {s}, \"l\": [1, 2"), ("{\"k\":", "} and so on"), ("{\"k\": ", f", \"s\": {s[:-1]}"),
    ]
    broken = F.element_at(F.array(*(F.concat(F.lit(a), k, F.lit(b)) for a, b in shapes)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.inline(F.array(t.parsed_json(broken, "k long, s string, b boolean"))))


@query(f"""WITH {_P}, x AS (SELECT *, CASE WHEN turn % 4 = 2 THEN '' ELSE question END AS q, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'so' END AS th, CASE conv_id % 3 WHEN 0 THEN left(answer, 8) WHEN 1 THEN answer ELSE answer || ' And a sentence that stands nowhere.' END AS a FROM p),
m AS (SELECT *, list_filter([CASE WHEN coalesce(q, '') = '' THEN 'missing question' END, CASE WHEN th IS NULL THEN 'missing thinking' END, CASE WHEN coalesce(a, '') = '' THEN 'missing answer' END], lambda x: x IS NOT NULL) AS missing,
  list_filter([CASE WHEN length(a) < 10 THEN 'too short' WHEN length(a) > 10000 THEN 'too long' END, CASE WHEN len(list_filter(string_split(a, '. '), lambda s: length(s) > 20 AND contains(lower(answer), lower(s)))) = 0 THEN 'not in content' END], lambda x: x IS NOT NULL) AS wrong FROM x)
SELECT conv_id, turn, array_to_string(CASE WHEN len(missing) > 0 THEN missing ELSE wrong END, ', ') AS problems FROM m""")
def reply_problems(spark, sf):
    """Answers as they are, cut short, or with a sentence more, against the given answer as the content."""
    rows = _pairs(spark, sf)
    q, thinking = F.when(F.col("turn") % 4 == 2, "").otherwise(F.col("question")), F.when(F.col("conv_id") % 5 > 0, "so")
    a = F.when(F.col("conv_id") % 3 == 0, F.substring("answer", 1, 8)).when(F.col("conv_id") % 3 == 1, F.col("answer")).otherwise(F.concat("answer", F.lit(" And a sentence that stands nowhere.")))
    return rows.select("conv_id", "turn", F.array_join(qa.reply_problems(q, thinking, a, F.col("answer")), ", ").alias("problems"))


@query(f"""WITH {PAIRS}, l AS (SELECT one, two, CASE WHEN a1 >= a2 THEN 'invalidate_old' ELSE 'invalidate_new' END AS action FROM p WHERE one > two)
SELECT one AS new_id, two AS old_id, action, 'newest_wins' AS strategy, 'resolved' AS status FROM l WHERE action = 'invalidate_old' AND (one % 50 = 7 OR two % 50 = 7)""")
def contradiction_log(spark, sf):
    """The log of overlapping versions, filtered by an edge's end and by what was done."""
    pairs = temporal_plans._pairs(spark, sf)
    end = lambda c: (F.col(c) % 50).cast("string")
    named = pairs.withColumns({"new_src": end("new_id"), "new_dst": F.lit("t"), "old_src": F.lit("s"), "old_dst": end("old_id")})
    log = temporal.resolution_log(temporal.resolved(named, "newest_wins"), "newest_wins", "overlap")
    found = temporal.log_filtered(log, "7", "invalidate_old", "resolved")
    return found.select("new_edge.id", F.col("existing_edge.id").alias("old_id"), "resolution.action", "resolution.strategy", "status").withColumnRenamed("id", "new_id")


#: Sentences in which each kind of entity stands, told apart by the customer's key.
_SAID = [
    ("met Mary Jones yesterday", [("Mary Jones", "PERSON", 0.7)]),
    ("works at Acme Robotics Inc. now", [("Acme Robotics Inc.", "ORGANIZATION", 0.75), ("Acme Robotics", "PERSON", 0.7)]),
    ("tried the gradient method twice", [("gradient method", "CONCEPT", 0.65)]),
    ("runs Docker at home", [("Docker", "TECHNOLOGY", 0.85)]),
    ("said nothing of note", []),
]


def _said(n: int) -> str:
    return " UNION ALL ".join(f"SELECT c_custkey, '{name}' AS name, '{kind}' AS type, {score}::DOUBLE AS confidence FROM customer WHERE c_custkey % {n} = {i}" for i, (_, found) in enumerate(_SAID) for name, kind, score in found)


def _sentences(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.element_at(F.array(*(F.lit(f"she {x}") for x, _ in _SAID)), (F.col("c_custkey") % len(_SAID) + 1).cast("int")).alias("text"), "c_nationkey")


@query(_said(len(_SAID)))
def entities_of_all_kinds(spark, sf):
    """Every pattern finds what is planted for it."""
    return entity.entities(_sentences(spark, sf), "c_custkey", "text")


#: A sentence for each relation pattern, with the source (null: the row's own name) and target it must give.
_RELATED = [
    ("Chapter two refers to Appendix nine", "Chapter two", "Appendix nine", "REFERENCES", 0.9),
    ("It holds, as mentioned in Section four", None, "Section four", "REFERENCES", 0.85),
    ("According to the manual", None, "manual", "REFERENCES", 0.85),
    ("See [Smith 2020]!", None, "Smith 2020", "REFERENCES", 0.9),
    ("Cooking requires fire", "fire", "Cooking", "PREREQUISITE", 0.85),
    ("Before using joins, you should know keys", "keys", "joins", "PREREQUISITE", 0.85),
    ("Flour is essential for bread", "bread", "Flour", "PREREQUISITE", 0.85),
    ("Rain causes floods", "Rain", "floods", "CAUSAL", 0.8),
    ("Due to frost, harvests fail", "frost", "harvests fail", "CAUSAL", 0.8),
    ("If it snows, then roads close", "it snows", "roads close", "CAUSAL", 0.8),
]


@query(" UNION ALL ".join(f"SELECT c_custkey, {repr(s) if s else 'c_name'} AS source, '{o}' AS target, '{k}' AS type, {c}::DOUBLE AS confidence FROM customer WHERE c_custkey % {len(_RELATED)} = {i}" for i, (_, s, o, k, c) in enumerate(_RELATED)))
def relations_of_all_kinds(spark, sf):
    """Every pattern finds the relation that is planted for it."""
    said = F.element_at(F.array(*(F.lit(x[0]) for x in _RELATED)), (F.col("c_custkey") % len(_RELATED) + 1).cast("int"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", said.alias("text"))
    return entity.relations(rows, "c_custkey", "text", name="c_name")


@query(f"""WITH e AS ({_said(len(_SAID))} UNION ALL SELECT c_custkey, 'nation ' || c_nationkey, 'GROUP', 0.9 FROM customer WHERE c_nationkey % 3 = 0 UNION ALL SELECT c_custkey, 'DOCKER', 'CONCEPT', 0.4 FROM customer WHERE c_custkey % 10 = 3),
k AS (SELECT 'docker' AS low, 'k1' AS key, 'docker' AS name, 'TECHNOLOGY' AS type, NULL AS confidence UNION ALL SELECT 'mary jones', 'k2', 'Mary JONES', 'PERSON', 0.2),
r AS (SELECT c_custkey, k.key, coalesce(k.name, e.name) AS name, coalesce(k.type, e.type) AS type, CASE WHEN k.key IS NULL THEN e.confidence ELSE greatest(e.confidence, coalesce(k.confidence, 0.8)) END AS confidence FROM e LEFT JOIN k ON k.low = lower(e.name))
SELECT c_custkey, key, name, type, max(confidence)::DOUBLE AS confidence FROM r GROUP BY ALL""")
def entities_united(spark, sf):
    """Patterns, a tagger's rows and keywords as three extractors; names that are known take the known row."""
    rows = _sentences(spark, sf)
    tagged = rows.where("c_nationkey % 3 = 0").select("c_custkey", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("name"), F.lit("GROUP").alias("type"), F.lit(0.9).alias("confidence"))
    words = rows.where("c_custkey % 10 = 3").select("c_custkey", F.lit("DOCKER").alias("name"), F.lit("CONCEPT").alias("type"), F.lit(0.4).alias("confidence"))
    known = spark.createDataFrame([("k1", "docker", "TECHNOLOGY", None), ("k2", "Mary JONES", "PERSON", 0.2)], "key string, name string, type string, confidence double")
    return entity.united({"tagger": tagged, "pattern": entity.entities(rows, "c_custkey", "text"), "keyword": words}, known, "c_custkey")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(embedding) > 0),
n AS (SELECT vec_id AS new_id, label, CASE WHEN vec_id % 3 = 0 THEN list_prepend(e[1] + 0.1, e[2:]) WHEN vec_id % 3 = 1 THEN list_transform(e, lambda x: -x) ELSE e END AS e, CASE WHEN vec_id % 3 = 2 THEN 'Doe, V' || vec_id ELSE 'other ' || vec_id END AS name FROM v),
x AS (SELECT new_id, vec_id AS old_id, 1.0 AS s FROM n JOIN v ON new_id = vec_id WHERE new_id % 3 = 2),
m AS (SELECT new_id, vec_id AS old_id, list_inner_product(n.e, v.e) / (sqrt(list_inner_product(n.e, n.e)) * sqrt(list_inner_product(v.e, v.e))) AS s FROM n JOIN v USING (label) WHERE new_id % 3 < 2 AND vec_id <> new_id + 1000000000),
b AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY s DESC, old_id) AS r FROM m WHERE s >= 0.8), f AS (SELECT new_id, old_id, s FROM x UNION ALL SELECT new_id, old_id, s FROM b WHERE r = 1)
SELECT n.new_id, f.old_id, round(f.s, 6)::DOUBLE AS confidence, CASE WHEN f.old_id IS NULL THEN 'insert' ELSE 'merge' END AS action FROM n LEFT JOIN f ON f.new_id = n.new_id""")
def resolve_by_vector(spark, sf):
    """New rows with a known row's vector moved a little, turned round, or with its name the other way round."""
    known = table(spark, sf, "embeddings").where(F.size("embedding") > 0).select("vec_id", "label", vector.doubles(F.col("embedding")).alias("e"))
    k, v = F.col("vec_id"), F.col("vec_id").cast("string")
    moved = F.when(k % 3 == 0, F.concat(F.array(F.get("e", 0) + 0.1), F.slice("e", 2, 10_000))).when(k % 3 == 1, F.transform("e", lambda x: -x)).otherwise(F.col("e"))
    new = known.select((k + 1_000_000_000).alias("new_id"), "label", moved.alias("e"), F.when(k % 3 == 2, F.concat(F.lit("Doe, V"), v)).otherwise(F.concat(F.lit("other "), v)).alias("name"))
    old = known.select(k.alias("old_id"), "label", "e", F.concat(F.lit("v"), v, F.lit(" doe")).alias("name"))
    out = entity.resolved(new, old, "new_id", "old_id", "name", "e", block="label")
    return out.select((F.col("new_id") - 1_000_000_000).alias("new_id"), "old_id", F.round("confidence", 6).alias("confidence"), "action")
