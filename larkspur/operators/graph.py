"""Property graphs as two tables: vertices, and edges (src, dst, ...). Iterations write each level in the shared folder."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from larkspur.sources.shared import kept as _kept

#: Rows of two or three keys that a task sorts or keeps apart.
ROWS = 500_000
#: Vertices (a few numbers each) up to which those of a graph are broadcast to its edges.
MEMBERS = 1_000_000


def dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """rows, some n, in as many partitions by key as they need, so that a task's memory does not follow the table's size."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS)), *by)


def _sets(rows: DataFrame, n: int, group: str, item: str) -> DataFrame:
    """(items__, src): the distinct items of each group that has several, once for each of them."""
    known = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item)
    sets = dealt(known, n, group).groupBy(group).agg(F.collect_set(item).alias("items__")).where(F.size("items__") > 1)
    return sets.select("items__", F.explode("items__").alias("src"))


def together(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(src, dst) of all pairs src < dst of items that some group holds, each once. A group's items are gathered once, and
    its pairs made where they lie."""
    n = rows.count()
    pairs = _sets(rows, n, group, item).select("src", F.explode("items__").alias("dst")).where("src < dst")
    return dealt(pairs, 4 * n, "src", "dst").distinct()


def companions(rows: DataFrame, group: str, item: str) -> DataFrame:
    """`together` as `near` has it: both directions and the items themselves, by their source. The items of a group travel as
    one row to each of them, and are pairs only there, an item's pairs one after the other."""
    n = rows.count()
    sets = dealt(_sets(rows, n, group, item), 4 * n, "src").sortWithinPartitions("src")
    pairs = sets.select("src", F.explode("items__").alias("dst")).distinct()
    return pairs.withColumn("w", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(1.0))


def successors(rows: DataFrame, group: str, item: str, *order: str) -> DataFrame:
    """(src, dst) of items that follow each other in a group's order, each pair once."""
    n, w = rows.count(), Window.partitionBy(group).orderBy(*order)
    next_ = dealt(rows.select(*dict.fromkeys([group, item, *order])), n, group).select(F.col(item).alias("src"), F.lead(item).over(w).alias("dst")).where("dst IS NOT NULL")
    return dealt(next_, n, "src", "dst").distinct()


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst, type) to walk along: outbound, inbound or any."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols)
    return {"outbound": edges, "inbound": back.select(*edges.columns), "any": edges.unionByName(back)}[direction]


def neighbourhood(edges: DataFrame, seeds: DataFrame, min_depth: int = 1, max_depth: int = 1, direction: str = "outbound", types: list[str] | None = None, prune: bool = True) -> DataFrame:
    """(seed, vertex, depth): breadth-first, each vertex once a seed at its least depth.

    prune drops edges of other types before walking; otherwise they carry the walk but their ends are not returned.
    """
    ways = directed(edges, direction)
    if types and prune:
        ways = ways.where(F.col("type").isin(types))
    wanted = F.col("type").isin(types) if types and not prune else F.lit(True)
    ways = ways.select("src", "dst", wanted.alias("wanted"))
    ways = _kept(ways) if max_depth > 1 else ways
    seen = _kept(seeds.select(F.col("id").alias("seed"), F.col("id").alias("vertex"), F.lit(0).alias("depth"), F.lit(True).alias("wanted")).distinct())
    level = seen
    for depth in range(1, max_depth + 1):
        step = level.join(ways.withColumnRenamed("wanted", "now"), level["vertex"] == ways["src"]).groupBy("seed", F.col("dst").alias("vertex")).agg(F.max("now").alias("wanted"))
        level = _kept(step.join(seen.select("seed", "vertex"), ["seed", "vertex"], "left_anti").withColumn("depth", F.lit(depth)).select("seed", "vertex", "depth", "wanted"))
        if level.isEmpty():
            break
        seen = _kept(seen.unionByName(level))
    return seen.where(F.col("depth").between(min_depth, max_depth)).where("wanted").select("seed", "vertex", "depth")


def paths(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(path, hops): simple paths of up to `hops` edges from the seeds, as arrays of vertices."""
    ends = edges.select("src", "dst").distinct()
    level = seeds.select(F.array("id").alias("path"))
    found = None
    for n in range(1, hops + 1):
        last = level.withColumn("at", F.element_at("path", -1))
        level = last.join(ends, last["at"] == ends["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"))
        now = level.withColumn("hops", F.lit(n))
        found = now if found is None else found.unionByName(now)
    return found


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree); both ends are counted in one aggregate."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def hubs(edges: DataFrame, share: float = 0.8) -> DataFrame:
    """Vertices whose in-degree exceeds a share of the largest."""
    d = degrees(edges)
    return d.crossJoin(F.broadcast(d.agg(F.max("in_degree").alias("most")))).where(F.col("in_degree") > share * F.col("most")).drop("most")  # one row


def bundled(edges: DataFrame, value: str = "value") -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum(F.coalesce(F.col(value), F.lit(1.0))).alias("value"), F.count("*").alias("edges"))


def clustered(vertices: DataFrame, edges: DataFrame, group: str, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Groups of more than `least` vertices collapse into one; edges follow, and loops fall away."""
    sizes = vertices.groupBy(group).agg(F.count("*").alias("members"))
    named = vertices.join(sizes, group, "left").select("id", F.when(F.col("members") > least, F.concat(F.lit("cluster:"), F.col(group).cast("string"))).otherwise(F.col("id").cast("string")).alias("node"))
    to = lambda end: named.select(F.col("id").alias(end), F.col("node").alias(f"{end}_node"))
    moved = edges.join(to("src"), "src").join(to("dst"), "dst").where("src_node <> dst_node")
    return named.groupBy("node").agg(F.count("*").alias("members")), moved.groupBy(F.col("src_node").alias("src"), F.col("dst_node").alias("dst")).agg(F.count("*").alias("edges"))


def numbered_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, place, degree) of distinct edges: places from 0 within a source, counted in 256 slices so that a vertex with
    very many neighbours is not sorted in one task."""
    ends = edges.select("src", "dst", F.substring(F.md5(F.col("dst").cast("string")), 1, 2).alias("slice"))
    place = F.row_number().over(Window.partitionBy("src", "slice").orderBy("dst")) - 1
    ends = _kept(dealt(ends, edges.count(), "src", "slice").distinct().withColumn("within", place))  # read twice, made once
    sizes = ends.groupBy("src", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "degree": F.sum("n").over(Window.partitionBy("src"))})
    return ends.join(sizes, ["src", "slice"]).select("src", "dst", (F.col("before") + F.col("within")).alias("place"), "degree")


def random_walks(edges: DataFrame, seeds: DataFrame, hops: int, seed: int = 0, per_seed: int = 1) -> DataFrame:
    """(id, walk, path): `per_seed` walks of up to `hops` steps from each seed (id), no vertex twice, the same for the same seed.

    A step draws a place by hash of the walk and takes the first vertex from there on that the walk has not seen: as many
    places as it has vertices, and one more, are enough. Only the drawn places are read, never all neighbours. A walk without a
    way on ends; its path is shorter.
    """
    numbered = _kept(numbered_edges(edges))
    degrees = numbered.where("place = 0").select(F.col("src").alias("at"), "degree")
    walks = seeds.select("id", F.explode(F.sequence(F.lit(1), F.lit(per_seed))).alias("walk"), F.array("id").alias("path"))
    for step in range(1, hops + 1):
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.col("walk").cast("string"), F.lit(str(step)))), 1, 8), 16, 10).cast("long")
        going = walks.where(F.size("path") == step).withColumn("at", F.element_at("path", -1)).join(degrees, "at")
        tried = going.withColumn("try", F.explode(F.sequence(F.lit(0), F.least(F.size("path").cast("long"), F.col("degree") - 1).cast("int"))))
        asked = tried.withColumn("place", (draw + F.col("try")) % F.col("degree")).drop("degree")
        free = asked.join(numbered.select(F.col("src").alias("at"), "place", "dst"), ["at", "place"]).where(~F.array_contains("path", F.col("dst")))
        chosen = free.groupBy("id", "walk").agg(F.min_by("dst", "try").alias("next"))
        walks = _kept(walks.join(chosen, ["id", "walk"], "left").select("id", "walk", F.when(F.col("next").isNotNull(), F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path")))
    return walks



def has_cycle(edges: DataFrame) -> bool:
    """Peels vertices without incoming edges; what is left, if anything, lies on or behind a cycle."""
    left = _kept(edges.select("src", "dst").distinct())
    while True:
        n = left.count()
        if not n:
            return False
        rest = _kept(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        if rest.count() == n:
            return True
        left = rest


def structure(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, density, roots and terminals."""
    n, m = vertices.agg(F.count("*").alias("vertices")), edges.agg(F.count("*").alias("edges"))
    roots = vertices.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").agg(F.count("*").alias("roots"))
    ends = vertices.join(edges.select(F.col("src").alias("id")), "id", "left_anti").agg(F.count("*").alias("terminals"))
    one = n.crossJoin(m).crossJoin(roots).crossJoin(ends)  # one row each
    return one.withColumn("density", F.when(F.col("vertices") > 1, F.col("edges") / (F.col("vertices") * (F.col("vertices") - 1))).otherwise(0.0))


def layout(metrics: DataFrame) -> DataFrame:
    """A layout to draw a graph with: one root and few edges make a tree, dense graphs a matrix-like force layout."""
    tree = (F.col("roots") == 1) & (F.col("edges") == F.col("vertices") - 1)
    return metrics.withColumn("layout", F.when(tree, "tree").when((F.col("roots") > 0) & (F.col("terminals") > 0) & (F.col("density") < 0.1), "sankey").when(F.col("vertices") > 100, "radial").otherwise("force"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable against or along edges, by minimum labels and jumping."""
    edges = _kept(edges.select("src", "dst"))
    n = 2 * edges.count()
    both = _kept(dealt(directed(edges, "any").where("src <> dst"), n, "dst").distinct())
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    labels = _kept(ids.withColumn("component", F.col("id")))
    while True:
        near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("near"))
        low = _kept(labels.join(near, labels["id"] == near["src"], "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component")))
        far = low.select(F.col("id").alias("component"), F.col("component").alias("far"))
        labels = _kept(low.join(far, "component", "left").select("id", "was", F.least("component", "far").alias("component")))
        if labels.where("component <> was").isEmpty():
            return labels.select("id", "component")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): mutual reachability, by forward and backward minimum labels over the vertices not yet settled."""
    left = _kept(edges.select("src", "dst").distinct())
    ids = _kept(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct())
    settled = None

    def reach(e: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
        labels = _kept(nodes.withColumn(label, F.col("id")))
        while True:
            near = e.join(labels, e["src"] == labels["id"]).groupBy("dst").agg(F.min(label).alias("near"))
            new = _kept(labels.join(near, labels["id"] == near["dst"], "left").select("id", F.col(label).alias("was"), F.least(label, "near").alias(label)))
            labels = new.drop("was")
            if new.where(f"{label} <> was").isEmpty():
                return labels

    while True:  # each round settles the component of the smallest id at least
        forward = reach(left, ids, "f")
        backward = reach(directed(left, "inbound"), ids, "b")
        both = _kept(forward.join(backward, "id"))
        done = both.where("f = b").select("id", F.col("f").alias("component"))
        settled = done if settled is None else settled.unionByName(done)
        rest = _kept(both.where("f <> b"))
        if rest.isEmpty():
            break
        f, b = (rest.select(F.col("id").alias(x), F.struct("f", "b").alias(f"l{x}")) for x in ("src", "dst"))
        left = _kept(left.join(f, "src").join(b, "dst").where("lsrc = ldst").select("src", "dst"))
        ids = rest.select("id")
    return settled


def symmetric(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(src, dst, w): both directions, parallel weights summed, 1 where a weight is missing; a loop counts twice."""
    w = F.coalesce(F.col(weight), F.lit(1.0)).cast("double") if weight else F.lit(1.0)
    return dealt(directed(edges.select("src", "dst", w.alias("w")), "any"), 2 * edges.count(), "src", "dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, member: DataFrame, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """One row: the sum over communities of in / 2m - resolution (degree / 2m)^2, for member (id, community)."""
    w = F.coalesce(F.col(weight), F.lit(1.0)).cast("double") if weight else F.lit(1.0)
    a, b = (member.select(F.col("id").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    met = edges.select("src", "dst", w.alias("w")).join(a, "src").join(b, "dst").groupBy("c_src", "c_dst").agg(F.sum("w").alias("w"))
    within = met.unionByName(met.select(F.col("c_dst").alias("c_src"), F.col("c_src").alias("c_dst"), "w"))  # sums need no edge in both directions
    per = within.groupBy(F.col("c_src").alias("community")).agg(F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("degree"))
    total = per.agg(F.sum("degree").alias("m2"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m2") - resolution * F.pow(F.col("degree") / F.col("m2"), 2)).alias("modularity"))  # one row


def near(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(src, dst, w) as `symmetric`, with a row (v, v, w) for each vertex, 0 where it has no loop; a vertex's rows lie together."""
    w = F.coalesce(F.col(weight), F.lit(1.0)).cast("double") if weight else F.lit(1.0)
    edges = _kept(edges.select("src", "dst", w.alias("w")))
    ids = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct()
    ways = directed(edges, "any").unionByName(ids.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("w")))
    return dealt(ways, 2 * edges.count(), "src").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def communities(edges: DataFrame, weight: str | None = None, resolution: float = 1.0, sweeps: int = 100, least: int = 3) -> DataFrame:
    """(id, community) by `local_moving`."""
    return local_moving(near(edges, weight), resolution, sweeps, least)


def local_moving(ways: DataFrame, resolution: float = 1.0, sweeps: int = 100, least: int = 3) -> DataFrame:
    """(id, community): synchronous local moving to the neighbouring community of the best modularity gain, for ways as `near` gives.

    Deterministic: only moves to a smaller label are made in even sweeps and to a larger one in odd sweeps, so that two
    neighbours never swap; ties go to the smaller label. Communities under `least` join their strongest neighbour. Ways stay
    sorted by their source, and up to `MEMBERS` vertices are broadcast to them, so a sweep moves no edge and adds up a vertex's
    edges one after the other; a hub's edges are a stream in one task. In the first sweep each neighbour is a community. A sweep
    that gives back what was two sweeps before ends them: all that follow repeat these two, so which is last is known.
    """
    ways = ways.sortWithinPartitions("src", "dst").persist(StorageLevel.MEMORY_AND_DISK)
    degree = _kept(ways.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).repartition("id"))  # few files, not one a part of the ways
    sent = F.broadcast if degree.count() <= MEMBERS else lambda df: df
    m2 = degree.agg(F.sum("k")).first()[0] or 1.0
    member = degree.select("id", F.col("id").alias("community"), F.lit(None).cast(degree.schema["id"].dataType).alias("was"), "k")
    for sweep in range(sweeps):
        total = member.groupBy(F.col("community").alias("to")).agg(F.sum("k").alias("sum_k"))
        links = ways.select(F.col("src").alias("id"), "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.col("w")).alias("w"))
        if sweep:
            links = links.join(sent(member.select(F.col("id").alias("dst"), F.col("community").alias("to"))), "dst").groupBy("id", "to").agg(F.sum("w").alias("w"))
        else:
            links = links.withColumnRenamed("dst", "to")
        options = links.join(sent(member), "id").join(sent(total), "to")
        rest = F.col("sum_k") - F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * rest / m2, 9)
        direction = (F.col("to") <= F.col("community")) if sweep % 2 == 0 else (F.col("to") >= F.col("community"))
        old = [F.first(c).alias(c) for c in ("community", "was", "k")]
        best = options.where(direction).withColumn("gain", gain).groupBy("id").agg(F.min_by("to", F.struct(-F.col("gain"), "to")).alias("new"), *old)
        moved = _kept(best.select("id", F.col("new").alias("community"), F.col("community").alias("was"), "k", F.col("was").alias("before")).repartition("id"))
        member = moved.select("id", "community", "was", "k")
        if moved.where("before IS NULL OR community <> before").isEmpty():
            if (sweeps - sweep) % 2 == 0:  # an odd number of sweeps is left
                member = moved.select("id", F.col("was").alias("community"))
            break
    small = member.groupBy("community").agg(F.count("*").alias("members")).where(F.col("members") < least).select("community")
    few = _kept(member.join(small, "community", "left_semi").select(F.col("id").alias("src"), "community"))  # most graphs have few
    to = member.select(F.col("id").alias("dst"), F.col("community").alias("to"))
    ties = ways.join(sent(few), "src").join(sent(to), "dst").where("community <> to").groupBy("community", "to").agg(F.sum("w").alias("w"))
    ties = ties.groupBy("community").agg(F.min_by("to", F.struct(-F.col("w"), "to")).alias("to"))
    joined = member.join(ties, "community", "left").select("id", F.coalesce("to", "community").alias("community"))
    found = _kept(degree.select("id").join(joined, "id", "left"))  # an end that is null is in no community
    ways.unpersist()
    return found


def hub_communities(edges: DataFrame, least: int = 2) -> DataFrame:
    """(community, members): vertices with `least` outgoing edges and their direct neighbours; they may overlap."""
    out = edges.groupBy(F.col("src").alias("community")).agg(F.count("*").alias("edges"), F.collect_set("dst").alias("members"))
    return out.where(F.col("edges") >= least).select("community", F.array_sort(F.array_union("members", F.array("community"))).alias("members"))


def community_profile(member: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """(community, members, inner_edges, cohesion, homogeneity) with types (id, type)."""
    sizes = member.groupBy("community").agg(F.count("*").alias("members"))
    a, b = (member.select(F.col("id").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    inner = edges.select("src", "dst").join(a, "src").join(b, "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.count("*").alias("inner_edges"))
    kinds = member.join(types, "id").groupBy("community", "type").count().groupBy("community").agg((F.max("count") / F.sum("count")).alias("homogeneity"))
    pairs = F.col("members") * (F.col("members") - 1) / 2
    out = sizes.join(inner, "community", "left").join(kinds, "community", "left").withColumn("inner_edges", F.coalesce("inner_edges", F.lit(0)))
    return out.withColumn("cohesion", F.when(pairs > 0, F.col("inner_edges") / pairs).otherwise(0.0))


def community_tags(member: DataFrame, types: DataFrame, n: int = 3, least: int = 2, names: DataFrame | None = None) -> DataFrame:
    """(community, tags): its n most frequent types with `least` members at least, and the first word of its name (names:
    community, name) where that has several."""
    counts = member.join(types, "id").groupBy("community", "type").count().where(F.col("count") >= least)
    w = Window.partitionBy("community").orderBy(F.desc("count"), "type")
    best = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("community", F.col("type").alias("tag"))
    if names is not None:
        best = best.unionByName(names.where(F.col("name").contains(" ")).select("community", F.lower(F.split("name", " ")[0]).alias("tag")))
    return best.groupBy("community").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def community_table(member: DataFrame, sample: int = 5) -> DataFrame:
    ids = F.array_sort(F.collect_list("id"))
    return member.groupBy("community").agg(F.count("*").alias("member_count"), ids.alias("member_ids")).withColumn("sample_members", F.slice("member_ids", 1, sample))


def merged_communities(member: DataFrame, which: list, into) -> DataFrame:
    return member.withColumn("community", F.when(F.col("community").isin(which), F.lit(into)).otherwise(F.col("community"))).distinct()


def with_members(member: DataFrame, added: DataFrame) -> DataFrame:
    """member (community, id) with rows added, each pair once."""
    return member.select("community", "id").unionByName(added.select("community", "id")).distinct()


def without_members(member: DataFrame, removed: DataFrame) -> DataFrame:
    return member.join(removed.select("community", "id").distinct(), ["community", "id"], "left_anti")


def communities_of(member: DataFrame, ids: DataFrame) -> DataFrame:
    """(community, id) for the vertices of ids (id)."""
    return member.join(ids.select("id").distinct(), "id", "left_semi").select("community", "id")


def type_histogram(vertices: DataFrame) -> DataFrame:
    """(type, vertices): by type, else by group, else as unknown."""
    named = [F.col(c).cast("string") for c in ("type", "group") if c in vertices.columns]
    return vertices.groupBy(F.coalesce(*named, F.lit("unknown")).alias("type")).agg(F.count("*").alias("vertices"))


def forest(vertices: DataFrame, edges: DataFrame, root: str | None = None) -> DataFrame:
    """(node, parent, depth): all vertices (id, a string) as one tree, level by level.

    Without a root, the smallest vertex without incoming edges is one (the smallest of all where each has some). Vertices
    that it does not reach hang below `_root`, and so does the root then: first those without incoming edges from other such
    vertices, then, of each cycle left over, the smallest. A vertex with several parents on the level above goes to the smallest. No
    vertices give no rows.
    """
    ids, ways = _kept(vertices.select("id").distinct()), _kept(edges.select("src", "dst").where("src <> dst").distinct())
    if root is None:
        root = ids.join(ways.select(F.col("dst").alias("id")), "id", "left_anti").agg(F.min("id")).first()[0] or ids.agg(F.min("id")).first()[0]
    seen = ids.sparkSession.createDataFrame([(root, None, 0)] if root is not None else [], "node string, parent string, depth int")

    def walked(seen: DataFrame, level: DataFrame) -> DataFrame:
        while True:
            near = ways.join(level.select(F.col("node").alias("src"), "depth"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"), (F.max("depth") + 1).alias("depth"))
            level = _kept(near.join(seen.select("node"), "node", "left_anti"))
            if level.isEmpty():
                return seen
            seen = _kept(seen.unionByName(level))

    seen, whole = walked(seen, seen), True
    while True:
        rest = _kept(ids.join(seen.select(F.col("node").alias("id")), "id", "left_anti"))
        if rest.isEmpty():
            break
        inner = _kept(ways.join(rest.withColumnRenamed("id", "src"), "src", "left_semi").join(rest.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        tops = _kept(rest.join(inner.select(F.col("dst").alias("id")), "id", "left_anti"))
        if tops.isEmpty():
            tops = components(inner).select(F.col("component").alias("id")).distinct()
        start = _kept(tops.select(F.col("id").alias("node"), F.lit("_root").alias("parent"), F.lit(0).alias("depth")))
        seen, whole = walked(_kept(seen.unionByName(start)), start), False
    if whole:
        return seen
    below = seen.select("node", F.coalesce("parent", F.lit("_root")).alias("parent"), (F.col("depth") + 1).alias("depth"))
    return below.unionByName(seen.sparkSession.createDataFrame([("_root", None, 0)], seen.schema))


def tree_edges(edges: DataFrame, root) -> DataFrame:
    """(node, parent, depth) of a tree below a root."""
    level = edges.where(F.col("src") == root).select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.lit(1).alias("depth"))
    found = level
    while True:
        level = _kept(edges.join(level.select(F.col("node").alias("src"), "depth"), "src").select(F.col("dst").alias("node"), F.col("src").alias("parent"), (F.col("depth") + 1).alias("depth")).join(found.select("node"), "node", "left_anti"))
        if level.isEmpty():
            return found
        found = _kept(found.unionByName(level))


def numbered(nodes: DataFrame, key: str = "id") -> DataFrame:
    """nodes with `index`, their place by key from 0: rows are sorted in ranges, and ranges counted, so no task holds them all."""
    sorted_ = _kept(nodes.orderBy(key).withColumn("at__", F.monotonically_increasing_id()))
    part = F.shiftright("at__", 33)
    sizes = sorted_.groupBy(part.alias("part__")).agg(F.count("*").alias("n__"))  # a row a range
    before = sizes.select("part__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    return sorted_.withColumn("part__", part).join(F.broadcast(before), "part__").withColumn("index", F.col("before__") + F.col("at__") - F.shiftleft(F.col("part__"), 33)).drop("at__", "part__", "before__")


def indexed_links(nodes: DataFrame, links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """links with both ends as indexes of numbered nodes; links whose ends are no nodes are left out."""
    at = lambda end: nodes.select(F.col("id").alias(end), F.col("index").alias(f"{end}_index"))
    return links.join(at(source), source).join(at(target), target)


def shaped(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links for drawing: keys without their collection, names and weights with defaults, radius by degree."""
    bare = lambda c: F.element_at(F.split(F.col(c).cast("string"), "/"), -1)
    d = degrees(edges)
    have = set(vertices.columns)
    label = F.coalesce(*(F.col(c).cast("string") for c in ("name", "label", "title") if c in have), bare("id"))
    nodes = vertices.join(d.select("id", "degree"), "id", "left").select(bare("id").alias("id"), label.alias("name"), (F.col("type") if "type" in have else F.lit("default")).alias("type"), (5 + 5 * F.coalesce("degree", F.lit(0))).alias("radius"))
    value = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return nodes, edges.select(bare("src").alias("source"), bare("dst").alias("target"), value.alias("value"))


def detail_level(nodes: Column) -> Column:
    return F.when(nodes > 1000, "low").when(nodes > 200, "medium").otherwise("high")


def sampled(vertices: DataFrame, edges: DataFrame, n: int, how: str = "degree", group: str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The n vertices of highest degree, of a seeded shuffle, or of each group alike; and the edges between them."""
    if how == "degree":
        keep = vertices.join(degrees(edges), "id", "left").orderBy(F.desc_nulls_last("degree"), "id").limit(n)
    elif how == "random":
        keep = vertices.orderBy(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(n)
    else:
        groups = vertices.select(group).distinct().count()
        w = Window.partitionBy(group).orderBy("id")
        keep = vertices.withColumn("r__", F.row_number().over(w)).where(F.col("r__") <= max(1, n // max(groups, 1))).drop("r__")
    keep = _kept(keep.select(vertices.columns))
    inner = edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")
    return keep, inner
