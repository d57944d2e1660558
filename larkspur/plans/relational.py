"""Scans, filters, joins, aggregates, sets, updates and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import qa
from larkspur.plans.registry import query, table
from larkspur.sources import files, store


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def filter_sort_page(spark, sf):
    rows = table(spark, sf, "orders")
    return store.page(rows, store.equal(o_orderstatus="F") & (F.col("o_totalprice") > 100000), [F.desc("o_totalprice"), "o_orderkey"], 20, 5).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM customer WHERE c_custkey = 42")
def point_get(spark, sf):
    return store.point(table(spark, sf, "customer"), "c_custkey", 42)


@query("SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def sql_passthrough(spark, sf):
    text = "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderdate >= CAST(:since AS TIMESTAMP) GROUP BY 1"
    return store.sql(spark, text, {"orders": table(spark, sf, "orders")}, since="1996-01-01")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def update_merge(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment"))
    return store.updated(c, changes, "c_custkey")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1, 2")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return store.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query("SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 100) THEN 'reviewed' ELSE event_type END AS event_type FROM events")
def bulk_update_limited(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return store.bulk_updated(e, F.col("event_type") == "error", {"event_type": F.lit("reviewed")}, "event_id", 100)


@query("SELECT 'customers' AS t, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 3 <> 0")
def cascade_delete(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    root, (left,) = store.cascade(c, "c_custkey", c.where("c_custkey % 3 = 0"), [(o, "o_custkey")])
    n = lambda t, df: df.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n")
    return n("customers", root).unionByName(n("orders", left))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def keep_highest(spark, sf):
    return store.keep_highest(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 5 END + coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def counter_increment(spark, sf):
    """Customers' counts, of which each third is missing, raised by their orders."""
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 5).alias("orders"))
    return store.incremented(rows, table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "orders")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%' AND p_size BETWEEN 5 AND 20 AND list_has_any([p_brand, p_type], ['Brand#2', 'ECONOMY'])")
def like_overlap_range(spark, sf):
    rows = table(spark, sf, "part").withColumn("tags", F.array("p_brand", "p_type"))
    wanted = F.array(F.lit("Brand#2"), F.lit("ECONOMY"))
    return rows.where(F.col("p_name").ilike("%ring%") & F.col("p_size").between(5, 20) & F.arrays_overlap("tags", wanted)).select("p_partkey", "p_name")


@query("SELECT event_id, CASE WHEN value / 100 >= 0.9 THEN 'high' WHEN value / 100 >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM events")
def confidence_bands(spark, sf):
    return table(spark, sf, "events").select("event_id", qa.confidence_band(F.col("value") / 100).alias("band"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice BETWEEN 200000 AND 200500 OR o_totalprice IS NULL)")
def open_range(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").where(F.coalesce(F.col("o_totalprice").between(200000, 200500), F.lit(True))).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def lookup_join(spark, sf):
    n = table(spark, sf, "nation")
    return table(spark, sf, "customer").where("c_acctbal > 9000").join(n, F.col("c_nationkey") == n["n_nationkey"], "left").select("c_custkey", "c_name", "n_name")


@query("SELECT a.l_orderkey, a.l_linenumber AS one, b.l_linenumber AS two FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND abs(a.l_discount - b.l_discount) > 0.075")
def self_contradictions(spark, sf):
    li = table(spark, sf, "lineitem")
    side = lambda n: li.select("l_orderkey", F.col("l_linenumber").alias(n), F.col("l_discount").alias(f"d_{n}"))
    return side("one").join(side("two"), "l_orderkey").where("one <> two AND abs(d_one - d_two) > 0.075").select("l_orderkey", "one", "two")


@query("SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total, list_sort(list(o_orderkey))[1] AS first_order FROM orders GROUP BY 1")
def nested_collection(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("orders_"), F.sum("o_totalprice").alias("total"))
    return o.select("o_custkey", F.size("orders_").cast("long").alias("orders"), F.round("total", 2).alias("total"), F.col("orders_")[0]["o_orderkey"].alias("first_order"))


@query("SELECT count(*) AS total, count(c_mktsegment) AS filled, count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(DISTINCT c_nationkey) AS nations FROM customer")
def multi_count_profile(spark, sf):
    return table(spark, sf, "customer").agg(F.count("*").alias("total"), F.count("c_mktsegment").alias("filled"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_distinct("c_nationkey").alias("nations"))


@query("SELECT p_brand, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 7 GROUP BY 1")
def hop3_count(spark, sf):
    o, li, p = table(spark, sf, "orders").where("o_custkey = 7"), table(spark, sf, "lineitem"), table(spark, sf, "part")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).join(p, F.col("l_partkey") == p["p_partkey"]).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, round(s_acctbal * k, 2) AS impact FROM supplier JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS k FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey")
def hop_impact(spark, sf):
    k = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("l_orderkey").alias("k"))
    return table(spark, sf, "supplier").join(k, "s_suppkey").select("s_suppkey", F.round(F.col("s_acctbal") * F.col("k"), 2).alias("impact"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY orders DESC, c_custkey LIMIT 1")
def neighbour_top1(spark, sf):
    k = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf, "customer").select("c_custkey").join(k, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0))).orderBy(F.desc("orders"), "c_custkey").limit(1)


@query("SELECT p_name, s_name, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = 100")
def edge_attr_join(spark, sf):
    li, p, s = table(spark, sf, "lineitem").where("l_orderkey = 100"), table(spark, sf, "part"), table(spark, sf, "supplier")
    return li.join(p, F.col("l_partkey") == p["p_partkey"]).join(s, F.col("l_suppkey") == s["s_suppkey"]).select("p_name", "s_name", "l_quantity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)")
def semi_join(spark, sf):
    s = table(spark, sf, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    p = table(spark, sf, "part").where("p_size = 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(s, "l_suppkey", "left_semi").join(p, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY customers DESC, n_name LIMIT 20")
def count_group_top(spark, sf):
    k = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return k.join(table(spark, sf, "nation"), "n_nationkey").select("n_name", "customers").orderBy(F.desc("customers"), "n_name").limit(20)


@query("""SELECT 'type' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'band', CASE WHEN value / 100 >= 0.9 THEN 'high' WHEN value / 100 >= 0.7 THEN 'medium' ELSE 'low' END, count(*) FROM events GROUP BY 2""")
def review_facets(spark, sf):
    """Both facets in one pass by grouping sets."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("t"), qa.confidence_band(F.col("value") / 100).alias("b"))
    sets = rows.groupingSets([["t"], ["b"]], "t", "b").agg(F.count("*").alias("n"), F.grouping("t").alias("no_type"))
    return sets.select(F.when(F.col("no_type") == 1, "band").otherwise("type").alias("facet"), F.when(F.col("no_type") == 1, F.col("b")).otherwise(F.col("t")).alias("value"), "n")


@query("SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS previous FROM lineitem")
def sequential_adjacency(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_linenumber").over(w).alias("previous"))


@query("SELECT c_custkey, list_sort(list_intersect([c_mktsegment, c_nationkey::VARCHAR], ['BUILDING', '3'])) AS both_, list_sort(list_distinct([c_mktsegment, 'BUILDING'])) AS either FROM customer")
def array_sets(spark, sf):
    a = F.array("c_mktsegment", F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", F.array_sort(F.array_intersect(a, F.array(F.lit("BUILDING"), F.lit("3")))).alias("both_"), F.array_sort(F.array_union(F.array("c_mktsegment"), F.array(F.lit("BUILDING")))).alias("either"))


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def set_union(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    return a.unionByName(table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))).distinct()


@query("SELECT count(*) AS documents, 1 AS arrays FROM (SELECT r_regionkey FROM region)")
def json_array_export(spark, sf):
    one = files.json_array(table(spark, sf, "region"))
    parsed = F.from_json("json", "array<struct<r_regionkey int, r_name string>>")
    return one.select(F.size(parsed).cast("long").alias("documents"), F.lit(1).alias("arrays"))
