"""Operators on small hand-made tables: null and tie cases, properties, and worked examples of a pizza shop's graph."""

import re
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.functions.text import Closeness, close_ratios, partial_ratio
from larkspur.operators import conversation, entity, graph, qa, rank, risk, temporal
from larkspur.sources import files, store
from larkspur.streaming import jobs


def ts(s):
    return F.lit(s).cast("timestamp")


def test_null_start_holds_in_snapshots_but_not_for_edges(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, NULL, NULL), (2, TIMESTAMP'2024-01-01', NULL), (3, TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-02') AS t(k, valid_at, invalid_at)")
    at = ts("2024-01-02")
    assert {r.k for r in rows.where(temporal.valid(at)).collect()} == {1, 2}
    assert {r.k for r in rows.where(temporal.valid(at, missing_start=False)).collect()} == {2}


def test_versions_do_not_overlap_after_superseding(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 1, TIMESTAMP'2024-01-01', NULL), ('a', 2, TIMESTAMP'2024-01-03', NULL), ('a', 3, TIMESTAMP'2024-01-03', TIMESTAMP'2024-01-04'), ('b', 4, TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-02') AS t(k, v, valid_at, invalid_at)")
    out = {r.v: r for r in temporal.superseded(rows, ["k"], ["v"]).collect()}
    assert out[1].invalid_at == out[2].valid_at and out[2].invalid_at == out[3].valid_at and str(out[4].invalid_at) == "2024-01-02 00:00:00"


def test_split_timeline_gives_disjoint_spans(spark):
    row = spark.sql("SELECT TIMESTAMP'2024-01-02' new_valid_at, TIMESTAMP'2024-01-03' new_invalid_at, TIMESTAMP'2024-01-01' old_valid_at, CAST(NULL AS TIMESTAMP) old_invalid_at, TIMESTAMP'2024-01-02' new_created_at, TIMESTAMP'2024-01-01' old_created_at")
    r = temporal.resolved(row, "split_timeline").first()
    assert r.action == "split_in_three" and r.first_end == r.second_start and r.second_end == r.third_start and r.third_end is None
    m = temporal.resolved(row, "merge").first()
    assert m.merged_invalid_at is None and m.merged_valid_at == row.first().old_valid_at
    with pytest.raises(ValueError):
        temporal.resolved(row, "guess")


def test_fusion_is_symmetric_under_equal_weights(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "k int, rank int")
    b = spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "k int, rank int")
    s = {r.k: r.score for r in rank.fused({"a": a, "b": b}, {"a": 0.5, "b": 0.5}, "k").collect()}
    assert s[1] == pytest.approx(s[2]) and s[3] == pytest.approx(0.5 / 63 + 0.5 / 63)


def test_bm25_prefers_rare_words_and_breaks_ties_by_key(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "blue green"), (4, None)], "k int, t string")
    hits = [r.k for r in rank.top(rank.bm25(docs, "Red GREEN!", "k", "t"), 5, "k").collect()]
    assert hits[0] == 1 and hits[1:] == [2, 3]
    index = rank.postings(docs.where("t IS NOT NULL"), "k", "t")
    assert {r.k for r in rank.bm25_from_postings(index, "red", "k").collect()} == {1}
    assert rank.bm25(docs, "  ", "k", "t").count() == 0


def test_tag_filter_keeps_case_and_score_does_not(spark):
    docs = spark.createDataFrame([(1, ["A", "b"]), (2, ["a"]), (3, [])], "k int, tags array<string>")
    assert [(r.k, r.tag_score) for r in rank.tags(docs, ["A", "B"], "tags").collect()] == [(1, 1.0)]


def test_vector_search_filters_before_the_cut(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 10], i % 2) for i in range(10)], "k int, v array<float>, odd int")
    assert [r.k for r in rank.vector_search(rows, "v", [1.0, 0.0], 3, "k", where=F.col("odd") == 1).collect()] == [1, 3, 5]
    assert rank.vector_search(rows.withColumn("v", F.array(F.lit(0.0), F.lit(0.0))), "v", [1.0, 0.0], 1, "k").first().score == 0.0


def test_ratios():
    assert text.ratio("kitten", "sitting") == pytest.approx(100 * 2 * 4 / 13)
    assert text.partial_ratio("abcd", "xxabcdxx") == 100 and text.partial_ratio("", "") == 100 and text.partial_ratio("", "x") == 0
    assert text.partial_ratio("abcd", "xxabXcdxx") < 100
    assert text.token_set_ratio("new york mets", "mets york new") == 100


def plain_chunks(t, budget):
    parts = []
    for sentence in re.split(r"(?<=[.!?])\s+", t.strip()):
        if len(sentence) // 4 <= budget:
            parts.append(sentence)
            continue
        piece = ""
        for word in sentence.split():
            if piece and len(piece) + 1 + len(word) > 4 * budget:
                parts.append(piece)
                piece = word
            else:
                piece = f"{piece} {word}" if piece else word
        parts.append(piece)
    out = []
    for part in filter(None, parts):
        if out and (len(out[-1]) + 1 + len(part)) // 4 <= budget:
            out[-1] += f" {part}"
        else:
            out.append(part)
    return out


def test_chunks_keep_words_and_budget(spark):
    texts = ["One two three. " * 40 + "x" * 500 + ". End here!", "  a b\n", "", None, "word " * 300 + "end. Next one. " + "y" * 90, "A. B! C? d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["c"] for r in df.select("i", text.chunks(F.col("t"), 20).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_chunks(t or "", 20)
        assert " ".join(got[i]).split() == (t or "").split()
        assert all(len(p) // 4 <= 20 or " " not in p for p in got[i])


def test_names(spark):
    df = spark.createDataFrame([("Müller,  José",), ("John Q. Public",), (None,)], "n string")
    out = [r[0] for r in df.select(text.normalized_name(F.col("n"))).collect()]
    assert out[:2] == ["jose muller", "john q public"] and out[2] is None
    variants = df.select(text.name_variants(F.col("n"))).collect()[1][0]
    assert "john public" in variants and "public, john q." in variants


def test_parsed_json_repairs(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('sure: {"k": 2,} ok',), ("none",)], "t string")
    assert [r.k.k if r.k else None for r in df.select(text.parsed_json(F.col("t"), "k long").alias("k")).collect()] == [1, 2, None]


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("x", "y")]


def test_walks_and_components(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r.vertex, r.depth) for r in graph.neighbourhood(e, seeds, 1, 3).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    comp = {r.id: r.component for r in graph.components(e).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "x": "x", "y": "x"}
    strong = {r.id: r.component for r in graph.strong_components(e).collect()}
    assert strong["b"] == strong["c"] == "a" and strong["d"] == "d" and strong["y"] == "y"
    assert graph.has_cycle(e) and not graph.has_cycle(e.where("src = 'c' AND dst = 'd'"))


def test_communities_find_two_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(i)]
    e = spark.createDataFrame([*clique("a"), *clique("b"), ("a0", "b0")], "src string, dst string")
    found = graph.communities(e)
    assert {r.n for r in found.groupBy("community").agg(F.count("*").alias("n")).collect()} == {5}
    q = graph.modularity(e, found).first().modularity
    assert 0.4 < q <= 1


def test_sampling_and_shaping(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    v = spark.createDataFrame([(c,) for c in "abcdexy"], "id string")
    keep, inner = graph.sampled(v, e, 3)
    assert [r.id for r in keep.orderBy("id").collect()] == ["a", "b", "c"] and inner.count() == 3
    nodes, links = graph.shaped(e.select(F.concat(F.lit("n/"), "src").alias("src"), "dst"), v)
    assert links.where("source = 'a' AND value = 1").count() == 1 and nodes.count() == 7


def test_store_updates(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, t int")
    changed = store.updated(rows, spark.createDataFrame([(2, "z")], "k int, v string"), "k")
    assert {(r.k, r.v) for r in changed.collect()} == {(1, "a"), (2, "z")}
    up = store.upserted(rows, spark.createDataFrame([(2, "n", 2), (3, "c", 0)], "k int, v string, t int"), ["k"], "t")
    assert {(r.k, r.v) for r in up.collect()} == {(1, "a"), (2, "n"), (3, "c")}
    assert store.deleted(rows, rows.where("k = 1"), "k").count() == 1
    assert store.created(rows.drop("k").withColumn("key", F.lit(None).cast("string"))).where("key IS NOT NULL AND created_at IS NOT NULL").count() == 2
    assert store.bulk_updated(rows, F.col("t") > 0, {"v": F.lit("q")}, "k", 1).where("v = 'q'").count() == 1


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é"), (2, None)], "k int, v string")
    for fmt in ("json", "csv", "parquet"):
        path = str(tmp_path / fmt)
        files.write(rows, path, fmt, "gzip")
        back = spark.read.schema(rows.schema).option("header", True).format(fmt).load(path)
        assert {(r.k, r.v) for r in back.collect()} == {(1, "é"), (2, None)}
    doc = tmp_path / "doc.json"
    doc.write_text('{"document_id": "d", "pages": [{"page_number": 1, "blocks": [{"type": "heading", "text": "H", "level": 1}, {"type": "text", "text": "t"}]}]}')
    blocks = files.document_blocks(spark, str(doc))
    assert blocks.count() == 2
    kinds = {(r.source, r.target, r.type) for r in qa.block_relations(blocks).collect()}
    assert kinds == {("d:0:0", "d:0:1", "NEXT_IN_SEQUENCE"), ("d:0:0", "d:0:1", "CONTAINS")}


@pytest.mark.parametrize("n", [0, 1, 7, 103])
def test_split_sizes_are_exact(spark, n):
    out = {r.split: r.n for r in qa.split(spark.range(n), "id", {"train": 0.8, "val": 0.1, "test": 0.1}, 1).groupBy("split").agg(F.count("*").alias("n")).collect()}
    small = int(n * 0.1)
    assert out.get("val", 0) == out.get("test", 0) == small and sum(out.values()) == n


def test_citations(spark):
    pairs = spark.createDataFrame([(1, "The quick brown fox jumps over. Another sentence stands here"), (2, "Nothing of this kind is written anywhere at all")], "k int, a string")
    blocks = spark.createDataFrame([("Once the quick brown fox jumps over the dog. Another sentence stands here",)], "b string")
    s = {r.k: r.score for r in qa.citation_scores(pairs, blocks, "k", "a", "b").collect()}
    assert s[1] == 100 and s[2] < 85


@pytest.mark.parametrize("floor", [70.0, 85.0, 97.0])
def test_close_ratios_lose_no_window(floor):
    rng = random.Random(int(floor))
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 7)))
    hay = " ".join(word() for _ in range(150))
    needles, letters = ["", "a", "zzz", hay + "x"], "aeinrst zé"
    for _ in range(150):
        at, n = rng.randrange(-10, len(hay)), rng.randint(2, 90)
        cut = [*hay[max(at, 0) : at + n]]
        for _ in range(rng.randint(0, max(1, n // 4))):
            i = rng.randrange(len(cut) + 1)
            cut[i : i + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 1)
        needles.append("".join(cut))
    for text in (hay, hay[:40], "", "t"):
        wanted = {i: s for i, s in ((i, partial_ratio(n, text)) for i, n in enumerate(needles)) if s >= floor}
        assert close_ratios(needles, text, floor, 100) == pytest.approx(wanted)
        assert text != hay or len(wanted) > 20


def test_close_ratios_score_few_windows(monkeypatch):
    rng, scored, commons, parts = random.Random(1), [], text._commons, "th in er re an on nd es ha ti ou st en ed at or".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    hay, other = (" ".join(word() for _ in range(2_000)) for _ in range(2))
    needles = [other[i : i + 50] for i in range(0, 6_000, 100)] + [other[i : i + 100] for i in range(0, 2_000, 100)]
    monkeypatch.setattr(text, "_commons", lambda *a: scored.append(len(a[1])) or commons(*a))
    close_ratios(needles, hay, 85.0)
    assert 0 < sum(scored) < len(needles) * len(hay) / 20


@pytest.mark.parametrize("floor", [70.0, 85.0])
def test_closeness_finds_the_best_of_many_texts(floor):
    rng = random.Random(int(floor))
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 7)))
    texts = ["", "t", "\u4e2d\u6587 \U0001f355 stands here \u4e2d"] + [" ".join(word() for _ in range(n)) for n in (1, 3, 8, 15, 40, 60, 90)]
    needles = ["", "t", "\u4e2d\u6587 \U0001f355 stood here", texts[-2][-20:] + texts[-1][:20], "z" + texts[-1]]
    for t in texts[3:]:  # cut by the start, by the end, whole, and with letters changed
        for n in (12, 33, 50, 64, 65, 90, 300):
            for cut in ("zz" + t[: n - 2], t[-n:] + "zzz", t[5 : 5 + n]):
                at = rng.randint(0, len(cut))
                needles.append(cut[:at] + "z" * rng.randint(0, 2) + cut[at + 1 :])
    wanted = {i: s for i, s in ((i, max(partial_ratio(n, t) for t in texts)) for i, n in enumerate(needles)) if s >= floor}
    assert Closeness(needles, floor, 100).best(texts) == wanted and len(wanted) > 100
    for few in (["ab"], ["abc", "abcde"], ["ab", "abcdefghi"]):  # none of them long
        assert Closeness(few, floor).best(["xacdex"]) == {i: s for i, s in enumerate(partial_ratio(n, "xacdex") for n in few) if s >= floor}


def test_close_quotes_are_the_best_of_all_texts(spark):
    asked = spark.createDataFrame([("the quick brown fox",), ("the quick brown fox",), ("nothing alike here",), ("",), (None,)], "s string")
    texts = spark.createDataFrame([("a quick brown fax ran", 1), ("see the quack brown fox", 2), (None, 3), ("", 4)], "text string, score int")
    got = {r.s: r.score for r in qa.close_quotes(asked, texts, "s", "text").collect()}
    assert got == {"the quick brown fox": partial_ratio("the quick brown fox", "see the quack brown fox")}
    assert qa.close_quotes(asked, texts.limit(0), "s", "text").count() == 0


def test_reversal_and_edges(spark):
    p = spark.createDataFrame([(1, "What is the capital of France?", "Paris", 0.8)], "k int, q string, a string, c double")
    r = qa.reversed_pairs(p, "q", "a", "c").first()
    assert r.reversed_answer == "capital of France" and r.reversed_confidence == pytest.approx(0.72)
    ents = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.8), (1, "C", 0.1)], "k int, name string, confidence double")
    e = qa.edges(p, ents, "k", "c").first()
    assert (e.src, e.dst, e.review_status) == ("A", "B", "pending")


def test_conversation_links(spark):
    m = spark.createDataFrame([(1, 0, "user", "Hi. There"), (1, 1, "assistant", "Yes"), (1, 2, "user", "Q")], "c int, t int, role string, text string")
    assert [(r.turn, r.answer_turn) for r in conversation.turn_pairs(m, "c", "t", "role").orderBy("turn").collect()] == [(0, 1), (2, None)]
    assert conversation.transcripts(m, "c", "t", "role", "text").first().transcript == "User: Hi. There\n\nAssistant: Yes\n\nUser: Q"
    k = conversation.compactions(m, "c", "t", "role", "text").first()
    assert k.content == "Hi. Yes Q" and 0 < k.reduction_ratio < 1


def test_entities_and_merging(spark):
    d = spark.createDataFrame([(1, 'Ada Lovelace wrote "the first program" in Python, see Charles Notes [12 ab].'), (2, None)], "k int, t string")
    found = {(r.name, r.type) for r in entity.entities(d, "k", "t").collect()}
    assert ("Ada Lovelace", "PERSON") in found and ("Python", "TECHNOLOGY") in found
    assert ("12 ab", "REFERENCES") in {(r.target, r.type) for r in entity.relations(d.withColumn("n", F.lit("own")), "k", "t", name="n").collect()}
    lines = [(1, "Chapter two refers to the first part. As mentioned in Notes; the parser needs a lexer"), (2, "Rain causes floods. If it rains, then streets are wet (Smith) according to the law"), (3, None)]
    got = entity.relations(spark.createDataFrame(lines, "k int, t string").withColumn("n", F.lit("doc")), "k", "t", name="n").collect()
    assert {(r.k, r.source, r.target, r.type, r.confidence) for r in got} == {
        (1, "Chapter two", "the first part", "REFERENCES", 0.9),
        (1, "doc", "Notes", "REFERENCES", 0.85),
        (1, "a lexer", "the parser", "PREREQUISITE", 0.85),
        (2, "doc", "law", "REFERENCES", 0.85),
        (2, "doc", "Smith", "REFERENCES", 0.9),
        (2, "Rain", "floods", "CAUSAL", 0.8),
        (2, "it rains", "streets are wet", "CAUSAL", 0.8),
    }
    m = spark.sql("SELECT map('a', '1', 'b', '2') o, map('b', '3', 'c', '4') n").select(*(entity.merged_attributes(F.col("o"), F.col("n"), s).alias(s) for s in ("prefer_existing", "prefer_new", "intersection"))).first()
    assert m.prefer_existing == {"a": "1", "b": "2", "c": "4"} and m.prefer_new == {"a": "1", "b": "3", "c": "4"} and m.intersection == {}


def test_resolution_prefers_exact_names(spark):
    new = spark.createDataFrame([(1, "Doe, Jane", [1.0, 0.0]), (2, "Someone", [0.0, 1.0]), (3, "Nobody", [-1.0, 0.0])], "n int, name string, v array<double>")
    known = spark.createDataFrame([(10, "Jane Doe", [0.0, 1.0])], "k int, name string, v array<double>")
    out = {r.n: (r.k, r.action) for r in entity.resolved(new, known, "n", "k", "name", "v").collect()}
    assert out == {1: (10, "merge"), 2: (10, "merge"), 3: (None, "insert")}


def test_risk(spark):
    t = spark.createDataFrame([("T1", 1, "critical", "low", "hard", 0), ("T2", 2, "low", "high", "very_easy", 5)], "tactic string, id int, severity string, complexity string, detection string, countermeasures int")
    t = t.withColumn("risk", risk.score(F.col("severity"), F.col("complexity"), F.col("detection"), F.col("countermeasures")))
    assert {r.id: r.risk for r in t.collect()} == {1: 100.0, 2: 2.0}
    assert risk.critical_path(t, ["T1", "T2"], "id").count() == 2 and risk.critical_path(t, ["T1", "T9"], "id").count() == 0


def test_admission():
    ok, recent = jobs.admitted([0, 1, 2, 3, 11, 12], rate=0.3, burst=3, recent=[])
    assert ok == [True, True, True, False, True, True] and len(recent) == 3 or len(recent) == 2


def test_admission_keeps_calls_apart(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # a key spans batches
    try:
        rows = spark.sql("SELECT id, id % 2 AS k, timestamp_seconds(id * 100) AS ts FROM range(120)")
        got = {r.id: r.admitted for r in jobs.rate_limited(rows, "k", "ts", "id", 1 / 3600, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {i for i, ok in got.items() if ok} == {0, 1, 36, 37, 72, 73, 108, 109}


def test_streamed_attribution_writes_each_file_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    profiles = spark.createDataFrame([("A", "t1", 2.0), ("B", "t2", 1.0)], "actor string, technique string, weight double")
    (src / "1.json").write_text('{"observation_id": 1, "session": "s", "technique": "t1"}\n')
    for _ in range(2):
        jobs.attribute_continuously(jobs.observations(spark, str(src)), profiles, str(out), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(out))
    assert [(r.session, r.actor) for r in rows.collect()] == [("s", "A")]


PIZZA_ORDERS = [("cust_001", "o1"), ("cust_002", "o2"), ("cust_001", "o4"), ("cust_003", "o3")]


def test_most_frequent_customer(spark):
    o = spark.createDataFrame(PIZZA_ORDERS, "c string, o string")
    best = o.groupBy("c").count().orderBy(F.desc("count"), "c").first()
    assert (best.c, best["count"]) == ("cust_001", 2)


def test_sections_start_at_header_lines(spark):
    rows = spark.createDataFrame([(1, "lead\n**4. General Design**\nbody\n**4.1 Plant Basis ** \nmore"), (2, "no header"), (3, None), (4, ""), (5, "a **4 Not A Line** b\n**4 x**")], "k int, t string")
    got = {(r.k, r.number): r for r in text.sections(rows, "k", "t").collect()}
    assert set(got) == {(1, "4"), (1, "4.1"), (2, ""), (4, ""), (5, "")}
    assert got[1, "4"].title == "General Design" and got[1, "4"].start == 5 and got[1, "4.1"].title == "Plant Basis"
    assert got[1, "4.1"].start + got[1, "4.1"].length == len(rows.first().t) and got[2, ""].title == got[2, ""].content == "no header"


def test_forest_hangs_orphans_and_cycles_below_one_root(spark):
    vertices = spark.createDataFrame([(c,) for c in "abcdefgh"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("e", "f"), ("g", "h"), ("h", "g"), ("g", "g")], "src string, dst string")
    got = {r.node: (r.parent, r.depth) for r in graph.forest(vertices, edges).collect()}
    assert got == {"_root": (None, 0), "a": ("_root", 1), "b": ("a", 2), "c": ("a", 2), "d": ("b", 3), "e": ("_root", 1), "f": ("e", 2), "g": ("_root", 1), "h": ("g", 2)}
    whole = {r.node: (r.parent, r.depth) for r in graph.forest(vertices.where("id < 'e'"), edges.where("src < 'e'")).collect()}
    assert whole == {"a": (None, 0), "b": ("a", 1), "c": ("a", 1), "d": ("b", 2)}
    assert graph.forest(vertices.limit(0), edges.limit(0)).count() == 0


def test_inversion_takes_the_first_relation_and_ignores_others(spark):
    rows = spark.createDataFrame([("What leads to Failure?",), ("What is contained in X?",), ("Who came?",), (None,)], "q string").select(qa.inverted(F.col("q")).alias("r"))
    assert [r.r for r in rows.collect()] == ["What results from failure?", "What contains x?", None, None]


def test_rationale_leaves_out_what_is_missing_and_is_long_enough(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS t, 'FACTUAL' AS k, 'A' AS a, 'B' AS b, 0 AS n, CAST(NULL AS DOUBLE) AS s, false AS c")
    r = row.select(qa.rationale(F.col("t"), F.col("k"), F.col("a"), F.col("b"), F.lit(""), F.col("n"), F.col("s"), F.col("c")).alias("r")).first().r
    assert r == "Q&A extracted from document: Unknown. Establishes factual relationship between A and B"
    assert row.select(qa.hierarchy(F.lit("d/1"), path=F.col("t")).alias("h")).first().h == {"document_id": "d/1"}


def test_review_export_keeps_edges_without_entities(spark):
    e = spark.sql("SELECT * FROM VALUES (2, 'a', 'zz', 'QA_DERIVED', 0.95D, 'approved'), (1, 'a', 'b', 'QA_DERIVED', NULL, 'approved'), (3, 'a', 'b', 'OTHER', 1D, 'approved') AS t(id, src, dst, type, confidence, review_status)")
    n = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    assert {(r.edge.id, r.to_entity and r.to_entity.name) for r in qa.review_export(e, n, "id").collect()} == {(1, "B"), (2, None)}
    assert [r.edge.id for r in qa.review_export(e, n, "id", band="low").collect()] == [] and [r.edge.id for r in qa.review_export(e, n, "id", limit=1).collect()] == [1]


def test_threat_search_looks_into_arrays(spark):
    rows = spark.sql("SELECT 'ST1' AS id, 'Jam' AS name, CAST(NULL AS STRING) AS description, array('Laser DAZZLE') AS examples, CAST(NULL AS array<string>) AS countermeasures")
    assert [risk.found(rows, q, f).count() for q, f in [("dazzle", "all"), ("dazzle", "name"), ("st1", "id"), ("x", "all")]] == [1, 0, 1, 0]
    with pytest.raises(ValueError):
        risk.found(rows, "x", "severity")


def test_threat_import_and_metrics(spark, tmp_path):
    path = tmp_path / "threats.json"
    path.write_bytes(b"\xef\xbb\xbf" + b'{"collections": {"tactics": [{"_key": "T", "name": "t"}, {"_key": "T", "name": "t"}], "techniques": [{"_key": "a", "severity": "high", "tactic_ids": ["T"]}]}, "edges": {"uses": [{"_from": "a", "_to": "T"}], "follows": []}}')
    tactics, techniques, edges = files.threats(spark, str(path))
    assert tactics.count() == 1 and techniques.first()["severity"] == "high"
    assert [tuple(r) for r in edges.collect()] == [("uses", "a", "T")]
    row = risk.threat_metrics(spark.createDataFrame([(None, "odd", "hard", None)], "severity string, complexity string, detection string, countermeasures int")).first()
    assert (row.impact_score, row.likelihood_score, row.detection_score, row.mitigation_effectiveness) == (50, 60, 80, 10)


def test_captions_chunks_and_corpus(spark):
    rows = spark.createDataFrame([("Table 2.3 of 7", 1), ("none", 2), ("", 3), (None, 4)], "c string, k int")
    assert [r.n for r in rows.orderBy("k").select(text.first_number(F.col("c")).alias("n")).collect()] == ["2.3", None, None, None]
    chunk = text.chunk_records(spark.createDataFrame([("a\nb\n", "t", 5), (None, "t", 1)], "c string, t string, l int"), "c", "t", "l").collect()
    assert [(r.first_line, r.last_line) for r in chunk] == [(5, 7)]
    kept = qa.corpus(spark.createDataFrame([("text", "x"), ("figure", "x"), ("code", None), (None, "x")], "type string, text string"))
    assert kept.count() == 1


def test_reversal_swaps_the_last_name_of_all_lines(spark):
    rows = qa.reversed_pairs(spark.createDataFrame([("Did Ada Byron write\nto Émile Zölch or not?", "Yes", 0.8)], "q string, a string, c double"), "q", "a", "c")
    assert rows.first()["reversed_answer"] == "Émile Zölch"
