"""Sections, rationales and exports for review; searches of techniques; changes of communities; graphs as one tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as t
from larkspur.operators import graph as g
from larkspur.operators import qa
from larkspur.operators import risk as r
from larkspur.plans.qa import _P, _pairs
from larkspur.plans.registry import query, table
from larkspur.plans.risk import _T, _techniques
from larkspur.sources import store

_HEAD = r"\*\*(\d+(?:\.\d+)*\.?)\s+([A-Z0-9][^\n*]+?)\s*\*\*[ \t]*$"


@query(rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE CASE WHEN doc_id % 2 = 0 THEN 'lead' || chr(10) ELSE '' END || '**' || (doc_id % 9 + 1) || '. Part ' || doc_id || '**' || chr(10) || text || chr(10) || '**2.1 More **  ' || chr(10) || 'tail' END AS t FROM documents),
p AS (SELECT doc_id, t, string_split(regexp_replace(t, '(?m)^(\*\*\d+(?:\.\d+)*\.?\s+[A-Z0-9][^\n*]+?\s*\*\*[ \t]*)$', chr(1) || '\1', 'g'), chr(1)) AS p FROM d WHERE t IS NOT NULL),
x AS (SELECT doc_id, len(p) AS n, unnest(p) AS c, unnest(list_transform(p, lambda e, i: list_sum(list_transform(p[1:i], lambda y: length(y))) - length(e))) AS start FROM p),
h AS (SELECT *, regexp_extract(c, '(?m)\A{_HEAD}', 1) AS num, regexp_extract(c, '(?m)\A{_HEAD}', 2) AS ti FROM x)
SELECT doc_id, rtrim(num, '.') AS number, md5(CASE WHEN num = '' THEN c ELSE trim(ti) END) AS title, start::BIGINT AS start, length(c) AS length, md5(c) AS hash FROM h WHERE num <> '' OR n = 1""")
def section_split(spark, sf):
    """Documents with header lines put before and after their texts; every third is left as it is."""
    lead = F.when(F.col("doc_id") % 2 == 0, "lead\n").otherwise("")
    headed = F.concat(lead, F.lit("**"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(". Part "), F.col("doc_id").cast("string"), F.lit("**\n"), F.col("text"), F.lit("\n**2.1 More **  \ntail"))
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(headed).alias("t"))
    return t.sections(d, "doc_id", "t").select("doc_id", "number", F.md5("title").alias("title"), "start", "length", F.md5("content").alias("hash"))


_EDGES = """e AS (SELECT o_orderkey AS id, 'c' || o_custkey AS src, 's' || (o_orderkey % 50) AS dst, (o_orderkey % 10) / 10.0::DOUBLE AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN 'OTHER' ELSE 'QA_DERIVED' END AS type,
CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS review_status FROM orders), n AS (SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)"""


@query(f"WITH {_EDGES} SELECT e.id, e.confidence, a.name AS from_name, b.name AS to_name FROM e LEFT JOIN n a ON a.id = src LEFT JOIN n b ON b.id = dst WHERE type = 'QA_DERIVED' AND review_status = 'approved' AND confidence >= 0.7 AND confidence < 0.9")
def review_export(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), (F.col("o_orderkey") % 50).cast("string")).alias("dst"), ((F.col("o_orderkey") % 10) / 10.0).cast("double").alias("confidence"), F.when(F.col("o_orderkey") % 5 == 0, "OTHER").otherwise("QA_DERIVED").alias("type"), status.alias("review_status"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    out = qa.review_export(e, c.unionByName(s), "id", "approved", "medium", limit=None)
    return out.select("edge.id", "edge.confidence", F.col("from_entity.name").alias("from_name"), F.col("to_entity.name").alias("to_name"))


@query(f"WITH {_T} SELECT id, 'T-' || id AS name, tactic, severity, risk::VARCHAR AS risk_score, detection AS detection_difficulty, complexity AS exploitation_complexity, cm AS countermeasures_count FROM x")
def matrix_export(spark, sf):
    rows = r.matrix_rows(_techniques(spark, sf).withColumn("name", F.concat(F.lit("T-"), F.col("id").cast("string"))))
    return rows.toDF(*(c.lower().replace(" ", "_") for c in rows.columns))


def _parts(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("ST-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand").alias("examples"), F.array(F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("countermeasures"))


@query("""WITH p AS (SELECT 'ST-' || p_partkey AS id, lower(p_name) AS a, lower(p_type) AS b, lower(p_brand) AS c, 'size ' || p_size AS d FROM part)
SELECT 'brand#1' AS asked, id FROM p WHERE contains(lower(id), 'brand#1') OR contains(a, 'brand#1') OR contains(b, 'brand#1') OR contains(c, 'brand#1') OR contains(d, 'brand#1')
UNION ALL SELECT 'size 2', id FROM p WHERE contains(lower(id), 'size 2') OR contains(a, 'size 2') OR contains(b, 'size 2') OR contains(c, 'size 2') OR contains(d, 'size 2') UNION ALL SELECT 'widget', id FROM p WHERE contains(a, 'widget')""")
def threat_search(spark, sf):
    p = _parts(spark, sf)
    hits = lambda text, field="all": r.found(p, text, field).select(F.lit(text.lower()).alias("asked"), "id")
    return hits("BRAND#1").unionByName(hits("Size 2")).unionByName(hits("Widget", "name"))


@query(f"""WITH {_P}, q AS (SELECT conv_id, turn, 'Q&A extracted from document: ' || 'conversation ' || conv_id || CASE WHEN turn % 4 = 0 THEN '' ELSE '. Section: turn ' || turn END || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '. Based on ' || (conv_id % 3) || ' evidence blocks from source content' END ||
'. Establishes factual relationship between user and assistant' || CASE WHEN conv_id % 2 = 0 THEN '. Validated with confidence score of 0.75. Source citations verified and found in document' ELSE '' END AS w FROM p)
SELECT conv_id, turn, w AS rationale, CASE WHEN turn % 4 = 0 THEN 'document_id=' || conv_id ELSE 'level=' || turn END AS place FROM q""")
def edge_rationale(spark, sf):
    conv, even = F.col("conv_id"), F.col("conv_id") % 2 == 0
    section = F.when(F.col("turn") % 4 != 0, F.concat(F.lit("turn "), F.col("turn").cast("string")))
    why = qa.rationale(F.concat(F.lit("conversation "), conv.cast("string")), F.lit("FACTUAL"), F.lit("user"), F.lit("assistant"), section, conv % 3, F.when(even, 0.75), even)
    place = qa.hierarchy(conv, section_title=F.lit(None), level=F.when(F.col("turn") % 4 != 0, F.col("turn")))
    return _pairs(spark, sf).select("conv_id", "turn", why.alias("rationale"), F.array_join(F.transform(F.map_entries(place), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("place"))


_VERBS = ["causes", "is caused by", "leads to", "results from", "contains", "is contained in", "precedes", "follows", "shows"]
_TURNED = " ".join(f"WHEN contains(l, '{a}') THEN replace(l, '{a}', '{b}')" for a, b in qa.INVERSIONS)


@query(f"""WITH q AS (SELECT event_id, lower('What ' || {_VERBS}[event_id % 9 + 1] || ' a ' || event_type || ' of ' || user_id || '?') AS l FROM events), i AS (SELECT event_id, CASE {_TURNED} END AS t FROM q)
SELECT event_id, upper(left(t, 1)) || substr(t, 2) AS turned FROM i""")
def relation_inversions(spark, sf):
    verb = F.get(F.array(*map(F.lit, _VERBS)), (F.col("event_id") % 9).cast("int"))
    asked = F.concat(F.lit("What "), verb, F.lit(" a "), F.col("event_type"), F.lit(" of "), F.col("user_id").cast("string"), F.lit("?"))
    return table(spark, sf, "events").select("event_id", qa.inverted(asked).alias("turned"))


@query("SELECT '_root' AS node, NULL AS parent, 0 AS depth UNION ALL SELECT 'r' || r_regionkey, '_root', 1 FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 3 FROM customer")
def forest_edges(spark, sf):
    """Five regions without a common root: one is found, the others are orphans."""
    edge = lambda name, a, x, b, y: table(spark, sf, name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    e = edge("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edge("customer", "n", "c_nationkey", "c", "c_custkey"))
    v = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id")).unionByName(e.select(F.col("dst").alias("id")))
    return g.forest(v, e)


@query("SELECT coalesce(event_type, 'unknown') AS type, count(*) AS vertices FROM events GROUP BY 1")
def type_histogram(spark, sf):
    return g.type_histogram(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type")))


@query("""WITH c AS (SELECT c_nationkey AS community, c_mktsegment AS t, count(*) AS k FROM customer GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY k DESC, t) AS r FROM c),
a AS (SELECT community, t FROM r WHERE r <= 3 UNION SELECT n_nationkey, 'group' || (n_nationkey % 3) FROM nation) SELECT community, string_agg(t, ',' ORDER BY t) AS tags FROM a GROUP BY 1""")
def community_name_tags(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"), F.col("c_mktsegment").alias("type"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("community"), F.concat(F.lit("Group"), (F.col("n_nationkey") % 3).cast("string"), F.lit(" of "), "n_name").alias("name"))
    return g.community_tags(c.select("id", "community"), c.select("id", "type"), names=names).select("community", F.array_join("tags", ",").alias("tags"))


@query("""WITH m AS (SELECT s_nationkey AS community, s_suppkey AS id FROM supplier UNION SELECT 99, s_suppkey FROM supplier WHERE s_acctbal > 5000), l AS (SELECT * FROM m WHERE NOT (community = 3 AND id % 2 = 0))
SELECT community, id FROM l WHERE id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def community_changes(spark, sf):
    """Rich suppliers join community 99, every second one leaves community 3; then where those with a balance belong."""
    s = table(spark, sf, "supplier")
    member = s.select(F.col("s_nationkey").alias("community"), F.col("s_suppkey").alias("id"))
    more = g.with_members(member, s.where("s_acctbal > 5000").select(F.lit(99).alias("community"), F.col("s_suppkey").alias("id")))
    less = g.without_members(more, member.where("community = 3 AND id % 2 = 0"))
    return g.communities_of(less, s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 ORDER BY o_orderkey LIMIT 20")
def bulk_update_dry_run(spark, sf):
    return store.would_change(table(spark, sf, "orders"), (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 1000), "o_orderkey", 20).select("o_orderkey", "o_totalprice")
