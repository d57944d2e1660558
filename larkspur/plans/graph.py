"""Graph queries: suppliers and parts as a bipartite graph, customers in nations and regions as a tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import graph as g
from larkspur.plans.registry import query, table
from larkspur.sources.shared import kept

EDGES = "ed AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag AS type FROM lineitem)"
SMALL = "n AS (SELECT DISTINCT src, dst FROM ed)"
BOTH = "w AS (SELECT src, dst FROM n UNION SELECT dst, src FROM n)"


def _edges(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("type")).distinct()


def _plain(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


def _vertices(spark, sf):
    e = _plain(spark, sf)
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()


_LEVELS = f"""{EDGES}, {SMALL}, {BOTH}, l0 AS (SELECT 's1' AS v), l1 AS (SELECT DISTINCT dst AS v FROM w JOIN l0 ON src = v WHERE dst NOT IN (SELECT v FROM l0)),
l2 AS (SELECT DISTINCT dst AS v FROM w JOIN l1 ON src = v WHERE dst NOT IN (SELECT v FROM l0 UNION SELECT v FROM l1)),
l3 AS (SELECT DISTINCT dst AS v FROM w JOIN l2 ON src = v WHERE dst NOT IN (SELECT v FROM l0 UNION SELECT v FROM l1 UNION SELECT v FROM l2))"""


@query(f"WITH {_LEVELS} SELECT v AS vertex, 1 AS depth FROM l1 UNION ALL SELECT v, 2 FROM l2 UNION ALL SELECT v, 3 FROM l3")
def bfs_depth3(spark, sf):
    seeds = spark.createDataFrame([("s1",)], "id string")
    return g.neighbourhood(_plain(spark, sf), seeds, 1, 3, "any").select("vertex", "depth")


def _step(n: int) -> str:
    """A step of every walk: from the drawn place on, the first vertex that the walk has not seen."""
    draw = f"('0x' || substr(md5('7|' || id || '|1|{n}'), 1, 8))::BIGINT"
    return f"""t{n} AS (SELECT id, path, dst, k, row_number() OVER (PARTITION BY id ORDER BY k) AS r FROM (SELECT w.id, w.path, q.dst, k FROM w{n - 1} w JOIN (SELECT DISTINCT src, degree FROM q) d ON d.src = w.path[-1], range(0, {n}) x(k), q
  WHERE k < d.degree AND q.src = w.path[-1] AND q.place = ({draw} + k) % d.degree AND len(w.path) = {n} AND NOT list_contains(w.path, q.dst))),
w{n} AS (SELECT w.id, CASE WHEN t.dst IS NULL THEN w.path ELSE list_append(w.path, t.dst) END AS path FROM w{n - 1} w LEFT JOIN t{n} t ON t.id = w.id AND t.r = 1)"""


_WALKS = f"{EDGES}, {SMALL}, {BOTH}, q AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY substr(md5(dst), 1, 2), dst) - 1 AS place, count(*) OVER (PARTITION BY src) AS degree FROM w), w0 AS (SELECT DISTINCT src AS id, [src] AS path FROM n), {', '.join(_step(n) for n in (1, 2, 3))}"


@query(f"WITH {_WALKS} SELECT id, array_to_string(path, '>') AS path FROM w3")
def random_walks(spark, sf):
    """A walk of three steps from every supplier, over parts and suppliers."""
    e = kept(_plain(spark, sf))  # read three times
    walks = g.random_walks(g.directed(e, "any"), e.select(F.col("src").alias("id")).distinct(), 3, 7)
    return walks.select("id", F.array_join("path", ">").alias("path"))


@query(f"WITH {EDGES} SELECT DISTINCT dst AS vertex FROM ed WHERE src = 's1' AND type = 'A'")
def distinct_neighbourhood(spark, sf):
    seeds = spark.createDataFrame([("s1",)], "id string")
    return g.neighbourhood(_edges(spark, sf), seeds, 1, 1, "outbound", ["A"]).select("vertex")


@query(f"WITH {EDGES}, {SMALL}, {BOTH}, p2 AS (SELECT a.dst AS m, b.dst AS z FROM w a JOIN w b ON a.dst = b.src WHERE a.src = 's1' AND b.dst <> 's1'), p3 AS (SELECT m, z, c.dst AS y FROM p2 JOIN w c ON z = c.src WHERE c.dst NOT IN ('s1', m)) SELECT 2 AS hops, count(*) AS paths FROM p2 UNION ALL SELECT 3, count(*) FROM p3")
def simple_paths(spark, sf):
    seeds = spark.createDataFrame([("s1",)], "id string")
    return g.paths(g.directed(_plain(spark, sf), "any"), seeds, 3).where("hops > 1").groupBy("hops").agg(F.count("*").alias("paths"))


@query(f"WITH {EDGES}, {SMALL}, d AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM n UNION ALL SELECT dst, 1, 0 FROM n) GROUP BY id) SELECT id, in_degree, out_degree, degree FROM d WHERE in_degree > 0.8 * (SELECT max(in_degree) FROM d)")
def degree_hubs(spark, sf):
    return g.hubs(_plain(spark, sf))


@query("SELECT 's' || l_suppkey AS src, l_returnflag AS dst, round(sum(coalesce(l_quantity, 1)), 4) AS value, count(*) AS edges FROM lineitem GROUP BY ALL")
def bundle_edges(spark, sf):
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.col("l_returnflag").alias("dst"), F.col("l_quantity").alias("value"))
    return g.bundled(e).withColumn("value", F.round("value", 4))


_CLUSTERS = """c AS (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1), nm AS (SELECT 's' || s_suppkey AS id, CASE WHEN k > 4 THEN 'cluster:' || s_nationkey ELSE 's' || s_suppkey END AS node FROM supplier JOIN c USING (s_nationkey)),
ce AS (SELECT a.l_suppkey AS x, b.l_suppkey AS y FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)"""


@query(f"WITH {_CLUSTERS} SELECT p.node AS src, q.node AS dst, count(*) AS edges FROM ce JOIN nm p ON p.id = 's' || x JOIN nm q ON q.id = 's' || y WHERE p.node <> q.node GROUP BY ALL")
def cluster_nodes(spark, sf):
    v = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), "s_nationkey")
    li = table(spark, sf, "lineitem")
    a = li.where("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("x"))
    b = li.where("l_linenumber = 2").select("l_orderkey", F.col("l_suppkey").alias("y"))
    e = a.join(b, "l_orderkey").where("x < y").select(F.concat(F.lit("s"), "x").alias("src"), F.concat(F.lit("s"), "y").alias("dst"))
    return g.clustered(v, e, "s_nationkey", 4)[1]


@query(f"""WITH {EDGES}, {SMALL}, v AS (SELECT src AS id FROM n UNION SELECT dst FROM n)
SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM n) AS edges, (SELECT count(*) FROM v WHERE id NOT IN (SELECT dst FROM n)) AS roots, (SELECT count(*) FROM v WHERE id NOT IN (SELECT src FROM n)) AS terminals,
round((SELECT count(*) FROM n) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1.0)), 8) AS density, 'sankey' AS layout""")
def graph_metrics(spark, sf):
    return g.layout(g.structure(_vertices(spark, sf), _plain(spark, sf))).withColumn("density", F.round("density", 8))


@query("SELECT false AS tree_cycle, true AS ring_cycle")
def cycle_flags(spark, sf):
    nation = table(spark, sf, "nation")
    tree = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    ring = nation.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst"))
    return spark.createDataFrame([(g.has_cycle(tree), g.has_cycle(ring))], "tree_cycle boolean, ring_cycle boolean")


_TREE = "t AS (SELECT 'world' AS src, 'r' || r_regionkey AS dst FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query(f"WITH RECURSIVE {_TREE}, x AS (SELECT dst AS node, src AS parent, 1 AS depth FROM t WHERE src = 'world' UNION ALL SELECT t.dst, t.src, x.depth + 1 FROM t JOIN x ON t.src = x.node) SELECT node, parent, depth FROM x")
def tree_edges(spark, sf):
    edge = lambda t, a, x, b, y: table(spark, sf, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    e = table(spark, sf, "region").select(F.lit("world").alias("src"), F.concat(F.lit("r"), "r_regionkey").alias("dst")).unionByName(edge("nation", "r", "n_regionkey", "n", "n_nationkey")).unionByName(edge("customer", "n", "c_nationkey", "c", "c_custkey"))
    return g.tree_edges(e, "world")


_CO = "ce AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey)"


def _co(spark, sf):
    return g.together(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query(f"""WITH {_CO}, w AS (SELECT src, dst FROM ce UNION ALL SELECT dst, src FROM ce), m AS (SELECT w.src, w.dst, a.s_nationkey AS c, b.s_nationkey AS d FROM w JOIN supplier a ON a.s_suppkey = w.src JOIN supplier b ON b.s_suppkey = w.dst),
p AS (SELECT c, sum(CASE WHEN c = d THEN 1 ELSE 0 END) AS inside, count(*) AS deg FROM m GROUP BY c) SELECT round(sum(inside / m2 - (deg / m2) ** 2), 8) AS modularity FROM p, (SELECT sum(deg)::DOUBLE AS m2 FROM p)""")
def modularity(spark, sf):
    member = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    return g.modularity(_co(spark, sf), member).select(F.round("modularity", 8).alias("modularity"))


_NEXT = "e AS (SELECT DISTINCT l_suppkey AS src, nxt AS dst FROM (SELECT l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem) WHERE nxt IS NOT NULL)"


def _next(spark, sf):
    """Suppliers that follow each other on the lines of an order."""
    return g.successors(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"WITH RECURSIVE {_NEXT}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS id, src AS v FROM b UNION SELECT r.id, b.dst FROM r JOIN b ON r.v = b.src) SELECT id, min(v) AS component FROM r GROUP BY id")
def components(spark, sf):
    return g.components(_next(spark, sf))


@query(f"WITH RECURSIVE {_NEXT}, ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT id, id AS v FROM ids UNION SELECT r.id, e.dst FROM r JOIN e ON r.v = e.src) SELECT a.id, min(a.v) AS component FROM r a JOIN r b ON a.id = b.v AND a.v = b.id GROUP BY a.id")
def strong_components(spark, sf):
    return g.strong_components(_next(spark, sf))


@query()
def communities(spark, sf):
    """Labels depend on the order of moves, so only the rows are compared; tests hold the modularity."""
    return g.local_moving(g.companions(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey"))


@query(f"WITH {EDGES}, {SMALL}, h AS (SELECT src AS community FROM n GROUP BY src HAVING count(*) >= 2) SELECT community, count(*) + 1 AS members FROM h JOIN n ON src = community GROUP BY community")
def communities_fallback(spark, sf):
    return g.hub_communities(_plain(spark, sf)).select("community", F.size("members").cast("long").alias("members"))


@query(f"""WITH {_CO}, s AS (SELECT s_nationkey AS community, count(*) AS members FROM supplier GROUP BY 1),
i AS (SELECT a.s_nationkey AS community, count(*) AS inner_edges FROM ce JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst WHERE a.s_nationkey = b.s_nationkey GROUP BY 1),
k AS (SELECT community, max(c) / sum(c) AS homogeneity FROM (SELECT s_nationkey AS community, s_acctbal > 5000 AS ty, count(*) AS c FROM supplier GROUP BY ALL) GROUP BY 1)
SELECT community, members, coalesce(inner_edges, 0) AS inner_edges, round(homogeneity, 6) AS homogeneity, round(CASE WHEN members > 1 THEN coalesce(inner_edges, 0) / (members * (members - 1) / 2.0) ELSE 0.0 END, 6) AS cohesion FROM s LEFT JOIN i USING (community) LEFT JOIN k USING (community)""")
def cohesion(spark, sf):
    s = table(spark, sf, "supplier")
    member = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    out = g.community_profile(member, _co(spark, sf), s.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 5000).alias("type")))
    return out.withColumns({"homogeneity": F.round("homogeneity", 6), "cohesion": F.round("cohesion", 6)})


@query("""WITH c AS (SELECT c_nationkey AS community, c_mktsegment AS t, count(*) AS k FROM customer GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY k DESC, t) AS r FROM c)
SELECT community, string_agg(t, ',' ORDER BY t) AS tags FROM r WHERE r <= 3 GROUP BY community""")
def community_tags(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"), F.col("c_mktsegment").alias("type"))
    return g.community_tags(c.select("id", "community"), c.select("id", "type")).select("community", F.array_join("tags", ",").alias("tags"))


@query("SELECT s_nationkey AS community, count(*) AS member_count, list_extract(list_sort(list(s_suppkey)), 1) AS first_member FROM supplier GROUP BY 1")
def community_table(spark, sf):
    t = g.community_table(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community")))
    return t.select("community", "member_count", F.element_at("sample_members", 1).alias("first_member"))


@query("SELECT CASE WHEN s_nationkey IN (1, 2) THEN 99 ELSE s_nationkey END AS community, count(*) AS members FROM supplier GROUP BY 1")
def community_merge(spark, sf):
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))
    return g.merged_communities(m, [1, 2], 99).groupBy("community").agg(F.count("*").alias("members"))


@query(f"WITH {EDGES}, {SMALL}, v AS (SELECT src AS id FROM n UNION SELECT dst FROM n), k AS (SELECT id FROM v ORDER BY md5(id || '|5'), id LIMIT 60) SELECT src, dst FROM n WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def sample_random(spark, sf):
    return g.sampled(_vertices(spark, sf), _plain(spark, sf), 60, "random", seed=5)[1]


@query(f"WITH {EDGES}, {SMALL}, d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM n UNION ALL SELECT dst FROM n) GROUP BY id), k AS (SELECT id FROM d ORDER BY k DESC, id LIMIT 50) SELECT src, dst FROM n WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def sample_degree(spark, sf):
    return g.sampled(_vertices(spark, sf), _plain(spark, sf), 50)[1]


@query("SELECT c_custkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r <= 100 // (SELECT count(DISTINCT c_mktsegment) FROM customer)")
def sample_groups(spark, sf):
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"))
    none = spark.createDataFrame([], "src long, dst long")
    return g.sampled(v, none, 100, "group", "g")[0].select("id")


@query(f"WITH {EDGES}, {SMALL}, d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM n UNION ALL SELECT dst FROM n) GROUP BY id) SELECT id, id AS name, 'default' AS type, 5 + 5 * k AS radius FROM d")
def graph_shaping(spark, sf):
    e = _plain(spark, sf).select(F.concat(F.lit("v/"), "src").alias("src"), F.concat(F.lit("v/"), "dst").alias("dst"))
    v = _vertices(spark, sf).select(F.concat(F.lit("v/"), "id").alias("id"))
    return g.shaped(e, v)[0].withColumn("radius", F.col("radius").cast("long"))


@query(r"""WITH d AS (SELECT doc_id, n_chars, source FROM documents), s AS (SELECT doc_id, source FROM d ORDER BY n_chars DESC, doc_id LIMIT 5), m AS (SELECT s.doc_id AS seed, d.doc_id AS related, row_number() OVER (PARTITION BY s.doc_id ORDER BY d.doc_id) AS r FROM s JOIN d USING (source) WHERE d.doc_id <> s.doc_id)
SELECT seed, count(*) AS related FROM m WHERE r <= 100 GROUP BY seed""")
def graph_expansion(spark, sf):
    """Seeds of a ranked search with what a bounded walk through their sources reaches, at most 100 a seed."""
    from pyspark.sql import Window

    docs = table(spark, sf, "documents")
    e = docs.select(F.concat(F.lit("d"), "doc_id").alias("src"), F.concat(F.lit("s"), F.col("source")).alias("dst"))
    seeds = docs.orderBy(F.desc("n_chars"), "doc_id").limit(5).select(F.concat(F.lit("d"), "doc_id").alias("id"))
    near = g.neighbourhood(e, seeds, 2, 2, "any").withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("vertex"))).where("r <= 100")
    return near.groupBy(F.substring("seed", 2, 20).cast("long").alias("seed")).agg(F.count("*").alias("related"))
