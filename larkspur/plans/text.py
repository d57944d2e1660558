"""Text functions, entities, relations and similarity joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as t
from larkspur.functions import vector
from larkspur.operators import entity
from larkspur.plans.registry import query, table

_SENT = r"list_filter(regexp_split_to_array(regexp_replace(trim(coalesce(text, '')), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


@query(f"SELECT item_id, len({_SENT}) AS sentences FROM benchmark")
def sentences(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(t.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("SELECT doc_id, length(coalesce(text, '')) // 4 AS tokens FROM documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256(text) AS hash, substr(md5(text), 1, 10) AS short_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.content_hash(F.col("text")).alias("hash"), t.short_hash(F.col("text")).alias("short_hash"))


_LAST = "regexp_extract(a, '[^\\x01]*$')"
#: Sentences, long ones in parts of at most 800 characters, joined while the estimate stays within 200 tokens.
_CHUNKS = rf"""p AS (SELECT doc_id, {_SENT.replace("trim(coalesce(text, ''))", "regexp_replace(coalesce(text, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')")} AS s FROM documents),
w AS (SELECT doc_id, list_filter(flatten(list_transform(s, lambda x: CASE WHEN length(x) // 4 <= 200 THEN [x] ELSE string_split(list_reduce(list_filter(regexp_split_to_array(x, '[ \t\n\r\f\v]+'), lambda y: y <> ''),
  lambda a, y: CASE WHEN length({_LAST}) + 1 + length(y) > 800 THEN a || chr(1) || y ELSE a || ' ' || y END), chr(1)) END)), lambda x: x <> '') AS s FROM p),
c AS (SELECT doc_id, string_split(list_reduce(s, lambda a, y: CASE WHEN (length({_LAST}) + 1 + length(y)) // 4 <= 200 THEN a || ' ' || y ELSE a || chr(1) || y END), chr(1)) AS c FROM w WHERE len(s) > 0),
u AS (SELECT doc_id, unnest(c) AS content, generate_subscripts(c, 1) - 1 AS chunk FROM c)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk::INTEGER AS chunk, length(content) // 4 AS tokens, substr(md5(content), 1, 10) AS hash FROM u")
def chunks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(t.chunks(F.col("text"), 200)).alias("chunk", "content"))
    return rows.select("doc_id", "chunk", t.token_estimate(F.col("content")).alias("tokens"), t.short_hash(F.col("content")).alias("hash"))


@query("SELECT s_suppkey, lower(s_name) AS name, trim(regexp_replace(lower(s_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS normalized FROM supplier")
def normalized_names(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.lower("s_name").alias("name"), t.normalized_name(F.col("s_name")).alias("normalized"))


@query("SELECT p_partkey, list_sort([lower(p_name), regexp_replace(lower(p_name), '^(.*) (\\S+)$', '\\2, \\1')]) AS variants FROM part")
def name_variants(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_sort(t.name_variants(F.col("p_name"))).alias("variants"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+ [A-Z][a-z]+)', 1)) AS name FROM documents) SELECT doc_id, name, 'PERSON' AS type, 0.7::DOUBLE AS confidence FROM m GROUP BY doc_id, name""")
def entities_regex(spark, sf):
    return entity.entities(table(spark, sf, "documents"), "doc_id", "text", entity.ENTITY_PATTERNS[:1])


_ALL = " UNION ALL ".join(f"SELECT doc_id, trim(unnest(regexp_extract_all(text, '{p}', 1)), ' ') AS name, '{kind}' AS type, {confidence}::DOUBLE AS confidence FROM documents" for p, kind, confidence in entity.ENTITY_PATTERNS)
ENTITIES_SQL = f"en AS (SELECT doc_id, name, arg_max(type, confidence) AS type, max(confidence) AS confidence FROM ({_ALL}) GROUP BY doc_id, name)"


@query(f"WITH {ENTITIES_SQL} SELECT doc_id, name, type, confidence FROM en")
def entities_all(spark, sf):
    return entity.entities(table(spark, sf, "documents"), "doc_id", "text")


@query(r"""WITH m AS (SELECT page_id, url, list_transform(regexp_extract_all(html, '\[[^\]]+\]|\([^)]+\)'), lambda x: trim(x[2:-2], ' ')) AS t FROM pages)
SELECT page_id, url AS source, unnest(t[1:10]) AS target, 'REFERENCES' AS type, 0.9::DOUBLE AS confidence FROM m WHERE url IS NOT NULL""")
def relations_regex(spark, sf):
    """Citations of pages, which name the page as their source; tests hold the other patterns."""
    return entity.relations(table(spark, sf, "pages"), "page_id", "html", patterns=entity.RELATION_PATTERNS[3:4], name="url")


_SIM = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT a.vec_id AS one, b.vec_id AS two, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS sim FROM v a JOIN v b USING (label) WHERE a.vec_id <> b.vec_id)"


def _sides(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.withColumnRenamed("vec_id", "one"), e.withColumnRenamed("vec_id", "two")


@query(f"WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY one ORDER BY sim DESC, two) AS r FROM s WHERE sim >= 0.3) SELECT one, two, round(sim, 6) AS similarity FROM r WHERE r <= 5")
def similarity_join(spark, sf):
    a, b = _sides(spark, sf)
    return entity.similar_matches(a, b, "one", "two", "embedding", 0.3, 5, "label").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY one ORDER BY sim DESC, two) AS r FROM s WHERE sim > 0.25 AND one % 50 = 0) SELECT one, two, 'SIMILAR' AS type, round(sim, 6) AS confidence FROM r WHERE r <= 5")
def similarity_edges(spark, sf):
    a, b = _sides(spark, sf)
    out = entity.similar_matches(a.where("one % 50 = 0"), b, "one", "two", "embedding", 0.25, 5, "label", strict=True)
    return out.select("one", "two", F.lit("SIMILAR").alias("type"), F.round("similarity", 6).alias("confidence"))


@query("SELECT c.c_custkey AS one, s.s_suppkey AS two FROM customer c JOIN supplier s ON replace(lower(c.c_name), 'customer', 'supplier') = lower(s.s_name)")
def exact_name_match(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("one"), F.regexp_replace("c_name", "Customer", "SUPPLIER").alias("name"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("two"), F.col("s_name").alias("name"))
    return entity.exact_matches(c, s, "one", "two")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a=' || (c_custkey % 10) || ',b=y,c=z' ELSE 'b=y,c=z' END AS prefer_new, CASE WHEN c_custkey % 10 = 1 THEN 'a=1' ELSE '' END AS same FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL
SELECT c_custkey, 'a=1,b=y,c=z', 'a=1' FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT c_custkey, 'a=1,b=y,c=z', 'a=1' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 10 <> 1""")
def attribute_merge(spark, sf):
    c = F.col("c_custkey")
    even = F.when(c % 2 == 0, (c % 10).cast("string")).otherwise("1")
    old, new = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("x")), F.create_map(F.lit("a"), even, F.lit("b"), F.lit("y"), F.lit("c"), F.lit("z"))
    show = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, sf, "customer").select("c_custkey", show(entity.merged_attributes(old, new, "prefer_new")).alias("prefer_new"), show(entity.merged_attributes(old, new, "intersection")).alias("same"))


@query("""SELECT c_custkey, round((coalesce(CASE WHEN c_custkey % 3 = 0 THEN 3.0 ELSE 0.6 * 2 END, 0) + (c_nationkey = 3)::INT * 1.5 + 0.5 + CASE WHEN c_custkey % 2 = 0 THEN 0.8 * 2 ELSE 0 END) / (CASE WHEN c_custkey % 3 = 0 THEN 3.0 ELSE 2.0 END + 1.5 + 1 + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END), 6)::DOUBLE AS confidence FROM customer""")
def match_confidence(spark, sf):
    exact = F.col("c_custkey") % 3 == 0
    conf = entity.match_confidence(exact, F.lit(0.6), F.col("c_nationkey") == 3, F.lit(0.5), F.when(F.col("c_custkey") % 2 == 0, 0.8))
    return table(spark, sf, "customer").select("c_custkey", F.round(conf, 6).alias("confidence"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c AS (SELECT c_custkey, c_name, e, label FROM customer LEFT JOIN v ON vec_id = c_custkey), s AS (SELECT s_suppkey, s_name, e, label FROM supplier LEFT JOIN v ON vec_id = 2 * s_suppkey + 1),
x AS (SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM c JOIN s ON replace(lower(c_name), 'customer', 'supplier') = lower(s_name) GROUP BY 1),
m AS (SELECT c_custkey, s_suppkey, list_inner_product(c.e, s.e) / (sqrt(list_inner_product(c.e, c.e)) * sqrt(list_inner_product(s.e, s.e))) AS sim FROM c JOIN s USING (label) WHERE c_custkey <> s_suppkey AND c_custkey NOT IN (SELECT c_custkey FROM x)),
n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY sim DESC, s_suppkey) AS r FROM m WHERE sim >= 0.8), f AS (SELECT c_custkey, s_suppkey, 1.0 AS sim FROM x UNION ALL SELECT c_custkey, s_suppkey, sim FROM n WHERE r = 1)
SELECT c_custkey, s_suppkey, round(sim, 6)::DOUBLE AS confidence, CASE WHEN s_suppkey IS NULL THEN 'insert' ELSE 'merge' END AS action FROM customer LEFT JOIN f USING (c_custkey)""")
def resolve_entities(spark, sf):
    """Customers against suppliers by name, else by vector among those of the same label; many have no vector."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("e"), "label")
    c = table(spark, sf, "customer").select("c_custkey", F.regexp_replace("c_name", "Customer", "Supplier").alias("name"), F.col("c_custkey").alias("vec_id")).join(v, "vec_id", "left").drop("vec_id")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"), (2 * F.col("s_suppkey") + 1).alias("vec_id")).join(v, "vec_id", "left").drop("vec_id")
    return entity.resolved(c, s, "c_custkey", "s_suppkey", "name", "e", block="label").select("c_custkey", "s_suppkey", F.round("confidence", 6).alias("confidence"), "action")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse(spark, sf):
    broken = F.concat(F.lit("answer: "), F.regexp_replace("props", r"\}$", ",}"), F.lit(" done"))
    return table(spark, sf, "events").select("event_id", t.parsed_json(broken, "k long")["k"].alias("k"))


@query("SELECT vec_id, len(embedding) = 64 AS ok, 70 AS fitted_length FROM embeddings")
def embedding_checks(spark, sf):
    v = vector.doubles(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", vector.well_formed(v, 64).alias("ok"), F.size(vector.fitted(v, 70)).alias("fitted_length"))


@query("SELECT doc_id, 1.0::DOUBLE AS norm, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) AS alike FROM documents")
def hash_embeddings(spark, sf):
    """Unit vectors, and how many documents have the same one: those of equal text."""
    made = table(spark, sf, "documents").select("doc_id", vector.hash_embedding(F.col("text")).alias("e"))
    same = made.groupBy(F.xxhash64("e").alias("h")).agg(F.count("*").alias("alike"))
    return made.join(same, F.xxhash64("e") == F.col("h")).select("doc_id", F.round(vector.norm(F.col("e")), 6).alias("norm"), "alike")


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS shown FROM documents")
def truncated_values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.truncated(F.col("text"), 40).alias("shown"))


@query("SELECT item_id, CASE WHEN length(text) >= 50 AND item_id <= 20 THEN true ELSE false END AS edge_ok FROM benchmark")
def checked_edges(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("rationale"), F.when(F.col("item_id") <= 20, 0.5).otherwise(1.5).alias("confidence"))
    return entity.checked_edges(rows).select("item_id", "edge_ok")
