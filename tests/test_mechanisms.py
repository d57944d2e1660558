"""Written indexes, blocked comparisons, stateful streams, sources and other mechanisms against plain versions."""

import math
import random
import re
import time
import uuid
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import ivf, matrix, rank
from larkspur.sources import inverted
from larkspur.streaming import jobs


def texts(n=400, seed=3):
    r = random.Random(seed)
    common, rare = ["the", "of", "and", "Größe", "x1"], [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(r.choice([3, 8, 40, 300])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "THE the The")]


def plain_bm25(rows, query):
    docs = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in rows}
    average, n, out = sum(map(len, docs.values())) / len(docs), len(docs), {}
    for word in dict.fromkeys(query.lower().split()):
        df = sum(word in d for d in docs.values())
        for i, d in docs.items():
            if tf := d.count(word):
                out[i] = out.get(i, 0.0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average))
    return out


def test_index_of_segments_scores_as_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 8)
    rows = texts()
    index = inverted.Index(spark, f"{tmp_path}/index")
    assert index.search("the", 3).count() == 0 and index.scores("the").count() == 0
    for part in (0, 1, 2):
        index.add(spark.createDataFrame([x for x in rows if x[0] % 3 == part], "id long, text string"), "id", "text")
    again = inverted.Index(spark, f"{tmp_path}/index")
    assert len(again.segments) == 3
    for query in ("the of", "w7 the größe nothing", "w3"):
        want = plain_bm25(rows, query)
        got = {r["id"]: r["score"] for r in again.scores(query, "id").collect()}
        assert got == pytest.approx(want)
        best = [(r["id"], round(r["score"], 9)) for r in again.search(query, 7, "id", wave=4).orderBy(F.desc("score"), "id").collect()]
        assert best == [(i, round(s, 9)) for i, s in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:7]]
    assert again.search("nothing", 5).count() == 0 and again.search("", 5).count() == 0


def test_search_stops_at_the_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 16)
    rows = [(i, "filler " * (5 + i % 90) + "word " * (30 if i < 16 else 1)) for i in range(2000)]
    index = inverted.Index(spark, f"{tmp_path}/index")
    index.add(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    want = plain_bm25(rows, "word")
    best = [r["id"] for r in index.search("word", 5, "id", wave=20).orderBy(F.desc("score"), "id").collect()]
    assert best == [i for i, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:5]]
    assert index.known_blocks > 100 and index.scored_blocks < index.known_blocks / 3


def test_a_lookup_opens_the_folders_of_its_words(spark, tmp_path):
    index = inverted.Index(spark, f"{tmp_path}/index")
    index.add(spark.createDataFrame(texts(), "id long, text string"), "id", "text")
    files = index._of(index._postings, ["the"]).select("term", F.input_file_name().alias("f")).distinct().collect()
    assert {r["term"] for r in files} == {"the"} and len({r["f"].split("bucket=")[1].split("/")[0] for r in files}) == 1
    plan = index._of(index._postings, ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:200] and "EqualTo(term,the)" in plan


def vectors(n=600, dims=8, seed=2):
    r = np.random.default_rng(seed)
    v = r.normal(size=(12, dims))[r.integers(0, 12, n)] + r.normal(size=(n, dims)) * 0.3
    return [(i, int(i % 4 if i % 3 else 0), x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("rows_a_block", [16, 1024])
def test_best_matches(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(matrix, "ROWS", rows_a_block)
    monkeypatch.setattr(matrix, "TILE", 2)
    data = [*vectors(), (1000, 0, None), (1001, 0, [0.0] * 8), (1002, 0, [1.0, 2.0]), (1003, None, [1.0] * 8), (1004, 1, vectors()[5][2]), (1005, 1, vectors()[5][2])]
    df = spark.createDataFrame(data, "id long, label int, v array<double>").repartition(3)
    unit = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, g, x in data if x and g is not None}
    group = {i: (g, len(x)) for i, g, x in data if x}
    for floor, most, strict in ((0.9, 3, False), (0.97, None, True), (-1.0, 2, False)):
        want = []
        for a in unit:
            near = [(float(unit[a] @ unit[b]), b) for b in unit if a != b and group[a] == group[b]]
            near = sorted([(round(s, 9), b) for s, b in near if (s > floor if strict else s >= floor)], key=lambda x: (-x[0], x[1]))
            want += [(a, b) for _, b in near[:most]]
        got = matrix.best_matches(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", "v", floor, most, F.col("label"), strict=strict)
        found = [(r["a"], r["b"], r["similarity"]) for r in got.collect()]
        if most is None:
            assert sorted((a, b) for a, b, _ in found) == sorted(want)
        else:  # equal similarities in floating point may order either way
            assert Counter(a for a, _, _ in found) == Counter(a for a, _ in want)
            assert sum((a, b) in set(want) for a, b, _ in found) >= 0.98 * len(want)
    assert matrix.best_matches(df.limit(0).withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", "v", 0.5, 3).count() == 0


def test_inverted_lists(spark, tmp_path):
    data = [*vectors(1500), (9000, 0, None), (9001, 0, [0.0] * 8)]
    df = spark.createDataFrame(data, "id long, label int, v array<double>")
    index = ivf.VectorIndex.build(df, "id", "v", f"{tmp_path}/lists")
    assert len(index.numbers) > 10 and index.sizes.sum() == 1500
    again = ivf.VectorIndex(spark, f"{tmp_path}/lists")
    q = data[17][2]
    exact = [r["id"] for r in rank.vector_search(df.where("id < 9000"), "v", q, 10, "id").collect()]
    assert [r["id"] for r in again.certified(q, "v", "id", 10, 2).collect()] == exact
    asked = df.where("id % 50 = 0 AND id < 9000").withColumnRenamed("id", "q")
    truth = {(r["q"], r["id"]) for r in matrix.best_matches(asked, df.where("id < 9000"), "q", "id", "v", -2.0, 10).collect()}
    got = {(r["q"], r["id"]) for r in again.search_many(asked, "q", "v", "id", 10, 10).collect()}
    assert len(truth & got) >= 0.9 * len(truth) and again.share_read(asked, "v", 10).first()[0] < 0.5


def streamed(spark, tmp_path, batches, schema, start):
    """Runs `start(stream)` over files of one batch each; what it wrote and its progress."""
    source, name = f"{tmp_path}/in", f"t{uuid.uuid4().hex}"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1 if k < len(batches) - 1 else 0)  # files are taken by age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    df, mode = start(stream)
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name), query.recentProgress


def test_rate_limits_agree_and_silent_keys_leave(spark, tmp_path):
    r, t0 = random.Random(1), datetime(2024, 1, 1, tzinfo=timezone.utc)
    calls = sorted((t0 + timedelta(seconds=r.randint(0, 3000)), f"u{r.randint(0, 5)}") for _ in range(120))
    calls = [(i, k, t.replace(tzinfo=None)) for i, (t, k) in enumerate(dict.fromkeys(calls))]
    late = [(10_000 + k, "z", datetime(2024, 1, 2) + timedelta(hours=k)) for k in range(3)]
    third = len(calls) // 3
    found, progress = streamed(spark, tmp_path, [calls[:third], calls[third : 2 * third], calls[2 * third :], *([x] for x in late)], "id long, k string, t timestamp", lambda s: (jobs.rate_limited_stream(s, "k", "t", 1 / 60, 4), "append"))
    want = jobs.rate_limited(spark.createDataFrame(calls + late, "id long, k string, t timestamp"), "k", "t", "id", 1 / 60, 4)
    rows = lambda df, t: sorted((x["k"], x[t], x["admitted"]) for x in df.collect())
    assert rows(found, "time") == rows(want, "t") and found.where("NOT admitted").count() > 10
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) > held[-1]  # users who fell silent are forgotten


def test_cache_expires(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else clocks keep a run that takes what is there going
    render = lambda k: f"{k}-{time.time()}"
    source, checkpoint = f"{tmp_path}/in", f"{tmp_path}/checkpoint"

    def asked(keys):
        name = f"t{uuid.uuid4().hex}"
        spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).write.mode("append").parquet(source)
        stream = jobs.cached_stream(spark.readStream.schema("k string").parquet(source), "k", render, 25_000)
        stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/{name}")).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return {(r["k"], r["hit"]): r["rendered"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}

    start = time.time()
    first = asked(["a", "a", "b"])
    rendered = time.time()
    assert set(first) == {("a", False), ("a", True), ("b", False)} and first["a", False] == first["a", True]
    second = asked(["a"])
    if time.time() - start < 25:
        assert second == {("a", True): first["a", False]}
    time.sleep(max(0, 26 - (time.time() - rendered)))
    third = asked(["a"])
    assert set(third) == {("a", False)} and third["a", False] != first["a", False]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_replayed_cache(spark):
    rows = [(1, "a", datetime(2024, 1, 1, 0)), (2, "a", datetime(2024, 1, 1, 1)), (3, "a", datetime(2024, 1, 1, 2)), (4, "a", datetime(2024, 1, 1, 3)), (5, "a", datetime(2024, 1, 2)), (6, "b", datetime(2024, 1, 1, 1))]
    got = jobs.cache_replay(spark.createDataFrame(rows, "id long, k string, t timestamp"), "k", "t", "id", "2 hours")
    assert {r["id"]: r["hit"] for r in got.collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def written_records(folder):
    import json

    folder.mkdir()
    blocks = {"document": {"id": "d1", "pages": [{"page_num": 3, "blocks": [{"type": "section", "level": 1, "text": "Größe", "children": [{"type": "text", "text": "a"}, {"type": "list", "blocks": [{"type": "item", "text": "b"}]}]}, {"type": "text", "text": None}]}]}}
    (folder / "a.json").write_bytes(json.dumps(blocks, ensure_ascii=False).encode("utf-16"))
    (folder / "b.json").write_bytes(json.dumps([{"document_id": "d2", "pages": [{"blocks": [{"type": "text", "text": "café"}]}]}], ensure_ascii=False).encode("latin-1"))
    (folder / "c.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"id": "d3", "pages": None}).encode())
    (folder / "_skip.json").write_text("[")


def test_records_of_blocks_in_three_encodings(spark, tmp_path):
    from larkspur.sources import records

    records.register(spark)
    written_records(tmp_path / "in")
    got = spark.read.format("larkspur_records").option("layout", "blocks").load(str(tmp_path / "in"))
    assert [tuple(r) for r in got.orderBy("document", "path").collect()] == [("d1", 3, "0", "section", 1, "Größe"), ("d1", 3, "0.0", "text", None, "a"), ("d1", 3, "0.1", "list", None, None), ("d1", 3, "0.1.0", "item", None, "b"), ("d1", 3, "1", "text", None, None), ("d2", 0, "0", "text", None, "café")]


def test_line_files_are_cut_at_line_ends(spark, tmp_path):
    import json

    from larkspur.sources import records

    records.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"qa_pairs": [{"question": f"q{i}é", "answer": "x" * (i % 50), "confidence": i / 10}], "document_id": i} if i % 3 else {"question": f"q{i}é", "question_type": "FACTUAL"} for i in range(500)]
    (folder / "a.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\nnot json\n\n")
    (folder / "b.jsonl").write_bytes("\r\n".join(json.dumps(x) for x in lines[:20]).encode("utf-16"))
    read = lambda **o: spark.read.format("larkspur_records").options(layout="qa", **o).load(str(folder))
    for split in ("97", "1000", "1000000"):
        df = read(split=split)
        assert Counter(r["question"] for r in df.collect()) == Counter([x for i in range(500) for x in [f"q{i}é"] * (2 if i < 20 else 1)])
    assert read(split="1000").rdd.getNumPartitions() > 10
    with pytest.raises(Exception, match="JSON|Expecting"):
        read(strict="true").count()
    assert read().where("document IS NULL AND type = 'FACTUAL' AND confidence IS NULL").count() == 167 + 7


def test_records_as_a_stream_take_new_files_only(spark, tmp_path):
    import json

    from larkspur.sources import records

    records.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"m{i}.json").write_text(json.dumps({"messages": [{"role": "user", "content": str(i)}], "conversation_id": "c"}))

    def run(name):
        stream = spark.readStream.format("larkspur_records").option("per_trigger", "2").load(str(folder))
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/{name}")).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        q.processAllAvailable()
        n = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        q.stop()
        return sorted(r["content"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect()), n

    got, batches = run("one")
    assert got == list("01234") and max(batches) <= 2
    (folder / "m7.json").write_text(json.dumps({"role": "user", "content": "7"}))
    assert run("two")[0] == ["7"]


def test_glossary_of_many_terms(spark):
    from larkspur.functions.text import Glossary, find_terms

    r = random.Random(5)
    terms = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(2, 5))) for _ in range(r.randint(1, 3))) for _ in range(100_000)]
    text = " ".join(r.choice(terms) if r.random() < 0.5 else "zz" for _ in range(300)).upper()
    few = sorted(set(r.sample(terms, 3000)))
    pattern = re.compile(r"\b(?:" + "|".join(re.escape(t) for t in sorted(few, key=lambda t: (-len(t), t))) + r")\b", re.IGNORECASE)
    want = [(m[0].lower(), m.start(), m.end()) for m in pattern.finditer(text)]
    assert Glossary(few).spans(text) == want and len(want) > 20
    all_ = Glossary(terms).spans(text)
    assert len(all_) >= 150 and all(b <= c for (_, _, b), (_, c, _) in zip(all_, all_[1:]))
    df = spark.createDataFrame([(text,), (None,), ("İ ÉTÉ été",)], "t string")
    got = df.select(find_terms(F.col("t"), ["été", *few]).alias("s")).collect()
    assert [tuple(x) for x in got[0]["s"]] == want and got[1]["s"] == [] and [tuple(x) for x in got[2]["s"]] == [("été", 2, 5), ("été", 6, 9)]


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("terms", [["nation"], ["ab", "nations", "été", "notation", "a", "natural", "nat", "stations", "ration"]])
@pytest.mark.parametrize("cutoff", [60.0, 80.0, 100.0])
def test_close_words(spark, terms, cutoff):
    r = random.Random(6)
    words = sorted({"".join(r.choice("natios") for _ in range(r.randint(1, 9))) for _ in range(250)} | {"nation", "nations", "a", "été", "ete", "x" * 30})
    want = {(t, w): 200 * common_length(t, w) / (len(t) + len(w)) for t in terms for w in words}
    got = rank.close_words(spark.createDataFrame([(w,) for w in words], "word string"), terms, cutoff)
    assert {(r["term"], r["word"]): r["similarity"] for r in got.collect()} == pytest.approx({k: v for k, v in want.items() if v >= cutoff})


def test_overlaps_by_buckets_equal_all_pairs(spark):
    from larkspur.operators import temporal

    r, t0 = random.Random(4), datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    rows = []
    for i in range(300):
        s, n = r.uniform(0, 5000), r.choice([0, 0.001, 1, 5, 60, 900, 4000])
        rows.append((i, "a" if i % 4 else "b", None if r.random() < 0.05 else at(s), None if r.random() < 0.1 else at(s + n)))
    rows += [(300, "a", at(100), at(50)), (301, "a", at(1e8), at(2e9)), (302, None, at(0), None)]
    df = spark.createDataFrame(rows, "id long, k string, valid_at timestamp, invalid_at timestamp")
    meets = lambda x, y: (x[2] is None or y[3] is None or x[2] < y[3]) and (y[2] is None or x[3] is None or y[2] < x[3])
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] != y[0] and x[1] == y[1] and x[1] and meets(x, y))
    got = temporal.overlapping(df, df, ["k"], "id", "id").select("one", "two")
    assert sorted(map(tuple, got.collect())) == want
    assert temporal.overlapping(df.limit(0), df, ["k"], "id", "id").count() == 0


def test_walks_do_not_return_and_repeat_by_seed(spark):
    from larkspur.operators import graph

    r = random.Random(8)
    edges = [(f"v{r.randint(0, 30)}", f"v{r.randint(0, 30)}") for _ in range(80)] + [("hub", f"v{i % 31}") for i in range(200)] + [("end", "end"), ("v1", "dead")]
    e = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("hub",), ("end",), ("v1",), ("nowhere",)], "id string")
    got = {(x["id"], x["walk"]): x["path"] for x in graph.random_walks(e, seeds, 3, 1, 40).collect()}
    ways = {}
    for a, b in edges:
        ways.setdefault(a, set()).add(b)
    assert len(got) == 160
    for (start, _), path in got.items():
        assert path[0] == start and len(set(path)) == len(path) <= 4 and all(b in ways[a] for a, b in zip(path, path[1:]))
        assert len(path) == 4 or not ways.get(path[-1], set()) - set(path)
    assert len({p[1] for (s, _), p in got.items() if s == "hub"}) > 15
    assert got == {(x["id"], x["walk"]): x["path"] for x in graph.random_walks(e.repartition(3), seeds, 3, 1, 40).collect()}
    assert got != {(x["id"], x["walk"]): x["path"] for x in graph.random_walks(e, seeds, 3, 2, 40).collect()}


def test_references_by_number(spark):
    from larkspur.operators import qa

    rows = [("d", 1, 0, "table", "x", "Table 2: a"), ("d", 1, 1, "table", "x", "A table 2 again"), ("d", 1, 2, "image", None, "Figure 2.3 of 9"), ("d", 1, 3, "figure", None, "no kind 7"), ("d", 2, 0, "text", "See tab. 2, Table 2 and TABLE 23, fig 2.3.", None), ("d", 2, 1, "text", "figure 2 and Fig. 2.3!", None), ("e", 1, 0, "text", "Table 2", None), ("d", 2, 2, "text", None, None), ("d", 2, 3, "list", "Table 2", None)]
    b = spark.createDataFrame(rows, "document_id string, page int, idx int, type string, text string, caption string")
    got = sorted((r["source"], r["target"], r["reference_type"]) for r in qa.block_references(b).collect())
    assert got == [("d:2:0", "d:1:1", "table"), ("d:2:0", "d:1:2", "figure"), ("d:2:1", "d:1:2", "figure")]


def test_pairs_and_successors_in_as_many_parts_as_rows_need(spark, monkeypatch):
    """Pairs of items of a group, items that follow each other, and modularity with weights and loops; no part grows with the table."""
    from larkspur.operators import graph

    monkeypatch.setattr(graph, "ROWS", 10)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(30)]), i, rng.choice([None, *range(9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, n int, x int")
    pairs, follow = graph.together(df, "g", "x"), graph.successors(df, "g", "x", "n")
    assert pairs.rdd.getNumPartitions() >= 80 and follow.rdd.getNumPartitions() >= 20
    groups = {}
    for g, n, x in rows:
        groups.setdefault(g, []).append(x)
    known = [{x for x in v if x is not None} for g, v in groups.items() if g is not None]
    assert sorted(map(tuple, pairs.collect())) == sorted({(a, b) for v in known for a in v for b in v if a < b})
    assert {tuple(r) for r in follow.collect()} == {(a, b) for v in groups.values() for a, b in zip(v, v[1:]) if b is not None}
    e = [(rng.randrange(8), rng.randrange(8), rng.choice([None, 2.0, 0.5])) for _ in range(40)]
    both = [(a, b, 1.0 if w is None else w) for s, d, w in e for a, b in ((s, d), (d, s))]
    m2, c = sum(w for *_, w in both), lambda v: v % 3
    want = sum(sum(w for a, b, w in both if c(a) == k == c(b)) / m2 - (sum(w for a, _, w in both if c(a) == k) / m2) ** 2 for k in range(3))
    member = spark.createDataFrame([(v, c(v)) for v in range(8)], "id int, community int")
    assert graph.modularity(spark.createDataFrame(e, "src int, dst int, w double"), member, "w").first()[0] == pytest.approx(want)


def test_each_task_of_an_index_writes_one_bucket(spark, tmp_path, monkeypatch):
    """Several buckets in a task, as hashing deals them, made its memory a multiple of what a task is to write."""
    monkeypatch.setattr(inverted, "WRITTEN", 20)
    monkeypatch.setattr(inverted, "BLOCK", 8)
    monkeypatch.setattr(inverted, "BUCKETS", 8)
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(1, 12))) for i in range(120)]
    inverted.Index(spark, f"{tmp_path}/index").add(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    for kind in ("postings", "bounds"):
        writers = {}
        for file in tmp_path.glob(f"index/{kind}/**/part-*.parquet"):
            writers.setdefault(file.name.split("-")[1], set()).add(file.parent.name)
        assert len(writers) > 8 and all(len(buckets) == 1 for buckets in writers.values())


def test_best_matches_hold_a_strip_of_products(spark, monkeypatch):
    """Strips of any size give the same matches, and no strip is larger than asked for."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 5)))], "id long, v array<double>")
    found = {}
    for cells in (1 << 20, 130, 1):
        monkeypatch.setattr(matrix, "CELLS", cells)
        found[cells] = [(r["id"], r["other"], round(r["similarity"], 9)) for r in matrix.best_matches(rows, rows.withColumnRenamed("id", "other"), "id", "other", "v", -2.0, 3).orderBy("id", "other").collect()]
    assert len(found[1]) == 180 and found[1] == found[130] == found[1 << 20]


def test_numbered_edges_make_their_edges_once(spark, monkeypatch):
    """The edges of walks were made and sorted out twice, for their places and for their counts."""
    from larkspur.operators import graph

    made, real = [], graph._kept
    monkeypatch.setattr(graph, "_kept", lambda df, *a: made.append(df) or real(df, *a))
    rng = random.Random(2)
    pairs = [(rng.randrange(5), rng.randrange(30)) for _ in range(200)]
    got = {(r["src"], r["dst"]): (r["place"], r["degree"]) for r in graph.numbered_edges(spark.createDataFrame(pairs, "src int, dst int")).collect()}
    assert len(made) == 1 and set(got) == set(pairs)
    for s in range(5):
        mine = [got[p] for p in set(pairs) if p[0] == s]
        assert sorted(p for p, _ in mine) == list(range(len(mine))) and {d for _, d in mine} == {len(mine)}


def settled(edges, sweeps=100, least=3):
    """Synchronous local moving in dictionaries, sweep by sweep; and how many sweeps it takes until two give back what was before."""
    w, past, took = {}, [], None
    for a, b, x in edges:
        for s, d in ((a, b), (b, a)):
            w.setdefault(s, {})[d] = w.get(s, {}).get(d, 0.0) + x
    k, m2 = {v: sum(w[v].values()) for v in w}, sum(sum(x.values()) for x in w.values())
    c = {v: v for v in w}
    for sweep in range(sweeps):
        total, new = {}, {}
        for v in w:
            total[c[v]] = total.get(c[v], 0.0) + k[v]
        for v in w:
            links = {c[v]: 0.0}
            for d in w[v]:
                links[c[d]] = links.get(c[d], 0.0) + (w[v][d] if d != v else 0.0)
            gain = {to: round(x - k[v] * (total[to] - (k[v] if to == c[v] else 0.0)) / m2, 9) for to, x in links.items() if (to <= c[v] if sweep % 2 == 0 else to >= c[v])}
            new[v] = min(gain, key=lambda to: (-gain[to], to))
        past.append(c)
        c = new
        if took is None and len(past) > 1 and c == past[-2]:
            took = sweep + 1
    members = [*c.values()]
    ties = {}
    for v in w:
        for d in w[v]:
            if members.count(c[v]) < least and c[v] != c[d]:
                ties.setdefault(c[v], {})[c[d]] = ties.get(c[v], {}).get(c[d], 0.0) + w[v][d]
    to = {x: min(t, key=lambda y: (-t[y], y)) for x, t in ties.items()}
    return {v: to.get(c[v], c[v]) for v in w}, took


def test_communities_end_when_sweeps_repeat_and_move_no_edge(spark, monkeypatch):
    """Vertices that move to and fro went on for all sweeps, each of which shuffled the edges where vertices were not thought few."""
    from larkspur.operators import graph

    edges = next(e for seed in range(200) for r in [random.Random(seed)] for e in [sorted({(a, b) for a in range(14) for b in range(a) if r.random() < 0.5})] if settled([(a, b, 1.0) for a, b in e], 100) != settled([(a, b, 1.0) for a, b in e], 99))
    df, plans, real = spark.createDataFrame(edges, "src int, dst int"), [], graph._kept
    monkeypatch.setattr(graph, "_kept", lambda d, *a: plans.append(d._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]) or real(d, *a))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for sweeps in (100, 99, 3, 1):
            plans.clear()
            want, took = settled([(a, b, 1.0) for a, b in edges], sweeps)
            assert {r["id"]: r["community"] for r in graph.communities(df, sweeps=sweeps).collect()} == want
            assert len(plans) <= min(took or sweeps, sweeps) + 4
            walked = [p for p in plans if "InMemoryTableScan" in p]
            assert len(walked) >= min(took or sweeps, sweeps) and not any("SortMergeJoin" in p for p in walked[1:-1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_communities_equal_a_plain_version(spark, monkeypatch):
    """Weights, gaps, loops, parallel edges and small communities; vertices broadcast or joined; groups of items without their pairs made."""
    from larkspur.operators import graph

    for seed, most in ((1, 1_000_000), (2, 0)):
        monkeypatch.setattr(graph, "MEMBERS", most)
        r = random.Random(seed)
        rows = [(f"v{r.randrange(12)}", f"v{r.randrange(12)}", r.choice([None, 2.0, 0.5, 3.0])) for _ in range(25)] + [("x", "x", 1.0), ("y", "z", None)]
        got = {x["id"]: x["community"] for x in graph.communities(spark.createDataFrame(rows, "src string, dst string, w double"), "w").collect()}
        assert got == settled([(a, b, 1.0 if w is None else w) for a, b, w in rows])[0]
        items = [(r.choice([None, *range(12)]), r.choice([None, *range(15)])) for _ in range(60)]
        df = spark.createDataFrame(items, "g int, x int")
        pairs = [tuple(p) for p in graph.together(df, "g", "x").collect()]
        got = {x["id"]: x["community"] for x in graph.local_moving(graph.companions(df, "g", "x")).collect()}
        assert pairs and got == settled([(a, b, 1.0) for a, b in pairs])[0]
