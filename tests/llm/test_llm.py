"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and
columns that other tables have too."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larkspur.llm import common, embedding_dedup, fixity, line_dedup, mixing, ngram_join, packing, queries, sharding, topk_search, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def corpus(n=60, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(word() for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 5)))
        rows.append([i, text, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", None]), len(text)])
    for i in range(n, n + 30):  # near and exact copies
        words = rows[r.randrange(n)][1].split(" ")
        if r.random() < 0.6:
            words[r.randrange(len(words))] = "changed"
        rows.append([i, " ".join(words), "en", "src0", 0])
    rows += [[n + 30, None, None, None, None], [n + 31, "", "en", "src1", 0], [n + 32, "one two", "en", "src1", 7], [n + 33, "One\ttwo", "en", "src1", 7], [n + 34, "long words here " * 4000, "en", "src1", 0], [3, rows[3][1], rows[3][2], rows[3][3], rows[3][4]]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).withColumns({"n": F.lit("clash"), "key": F.lit(1), "hi": F.lit(2), "row": F.lit(0), "part": F.lit(0)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(rows, k, num, den):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("region,hot", [(192, 62_500), (3, 2)])
@pytest.mark.parametrize("k,num", [(4, 85), (5, 80), (2, 50)])
def test_ngram_join_is_exact(docs, monkeypatch, k, num, region, hot):
    monkeypatch.setattr(ngram_join, "REGION", region)  # also by the path of large regions,
    monkeypatch.setattr(ngram_join, "_HOT", hot)  # and with shingles that count as hot
    found = ngram_join.ngram_components(docs, words=k, num=num, den=100).collect()
    want = brute_components(corpus(), k, num, 100)
    assert len(found) == len(corpus())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_one_of_each_group_stays(docs, none):
    want = {i for i, (_, c) in brute_components(corpus(), 5, 80, 100).items() if i == c}
    kept = ngram_join.one_of_each(docs)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    assert ngram_join.ngram_components(none).count() == 0


def test_hot_shingles_are_found_however_thinly_they_are_spread(spark, monkeypatch):
    """One shingle stands once in each of 200 batches, others in fewer; each batch alone shows nothing."""
    monkeypatch.setattr(ngram_join, "_HOT", 100)
    r = random.Random(1)
    hot, near = 7 + (1 << 40), 7 + (1 << 41)  # in one cell
    rows = []
    for i in range(200):
        grams = [hot, *([near] if i < 60 else []), *(r.randrange(1 << 62) for _ in range(20))]
        rows.append((3, np.array(grams, np.int64).tobytes(), np.arange(len(grams), dtype=np.int64).tobytes()))
    blobs = spark.createDataFrame(rows, "bucket int, grams binary, keys binary").repartition(7)
    assert [(x["bucket"], x["hot"]) for x in ngram_join._hot_grams(blobs).collect()] == [(3, [hot])]


def test_lines_of_documents_with_names_like_ours(spark):
    rows = spark.createDataFrame([(1, "a repeated line\nown", 1), (2, "a repeated line\nother", 2)], "doc_id long, text string, n int")
    named = rows.withColumns({"lost__": F.lit("x"), "lost_id__": F.lit(5), "c0": F.lit(1), "hi": F.lit(2)})
    got = {x["doc_id"]: (x["kept__"], x["lost__"], x["lost_id__"]) for x in line_dedup.dedup_lines(named).collect()}
    assert got == {1: ("a repeated line\nown", "x", 5), 2: ("other", "x", 5)}


def test_metric_join_within_a_region():
    r = np.random.default_rng(0)
    base = r.choice(10**6, 400, replace=False).astype(np.uint64)
    sets = [np.sort(np.concatenate([base[r.random(400) > 0.04 * (i % 4)], r.choice(10**6, i % 7).astype(np.uint64) + 10**7])) for i in range(150)]
    index = ngram_join._Sets([s.tobytes() for s in sets], 85, 100)
    forest, out = ngram_join._Forest(np.arange(150)), []
    ngram_join._join(index, forest, np.arange(150), out)
    brute = ngram_join._Forest(np.arange(150))
    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                brute.unite(i, j)
    same = lambda f: f.up[:, None] == f.up[None, :]
    assert (same(forest) == same(brute)).all() and len(out) < 150


def brute_lines(rows):
    space, low = " \t\n\x0b\f\r", str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    key = lambda s: s.strip(space).translate(low)
    held = {}
    for i, text, *_ in rows:
        for k in {key(s) for s in (text or "").split("\n")}:
            if len(k) >= 10:
                held.setdefault(k, set()).add(i)
    first = {k: min(v) for k, v in held.items() if len(v) > 1}
    return {i: "\n".join(s for s in (text or "").split("\n") if first.get(key(s), i) == i) for i, text, *_ in rows}


@pytest.mark.parametrize("held", [32 << 20, 0])
def test_line_dedup(docs, none, monkeypatch, held):
    monkeypatch.setattr(line_dedup, "_FILTERS", held)  # broadcast, and joined in chunks
    out = line_dedup.dedup_lines(docs)
    want = brute_lines(corpus())
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and len(rows) == len(corpus())
    for r in rows:
        assert r.kept__ == want[r.doc_id] and r.n_lines__ == (r.text or "").count("\n") + 1
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_is_reversible(docs):
    old, new = docs.where("doc_id < 70"), docs.where("doc_id >= 70")
    state = line_dedup.build(old)
    grown = line_dedup.insert(state, new)
    everything = line_dedup.build(docs)
    rows = lambda df: sorted(map(tuple, df.select("hi", "lo", "docs", "first").collect()))
    lost = lambda s: sorted(map(tuple, line_dedup.lost_lines(s).collect()))
    assert rows(grown.counts) == rows(everything.counts) and lost(grown) == lost(everything)
    back = line_dedup.delete(grown, new)
    assert rows(back.counts) == rows(state.counts) and lost(back) == lost(state)
    tight = line_dedup.compacted(back)
    assert rows(tight.counts) == rows(state.counts) and lost(tight) == lost(state) and tight.updates == 0


def test_cuckoo_filter():
    keys = common.mix(np.arange(20_000, dtype=np.uint64)).view(np.int64)
    f = line_dedup.CuckooFilter.read(line_dedup._built(keys))
    assert f.holds(keys).all()
    others = common.mix(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64)).view(np.int64)
    assert f.holds(others).mean() < 0.01
    f.remove(keys[:10_000])
    assert f.holds(keys[10_000:]).all() and f.holds(keys[:10_000]).mean() < 0.01


def test_packing(docs, none):
    pieces = packing.tokenised(docs, TOKENIZER, 256).select("doc_id", "piece", "start", "length", "ids")
    out = packing.pack(pieces, 256).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    by = {}
    for r in out.itertuples():
        by.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in corpus():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        got = sorted(by[i], key=lambda r: (r.piece, r.sequence_id))
        got = got if i != 3 else got[:: len(got) // (len(ids) // 1024 + 1)]
        assert b"".join(r.ids for r in got) == ids and all(r.length == 256 for r in got[:-1])
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 256
    assert out.sequence_id.nunique() <= packing.lower_bound(out.length.to_numpy(), 256) + 1
    proof = packing.certificate(packing.pack(pieces, 256), 256).collect()
    assert [tuple(r) for r in proof] == [(out.sequence_id.nunique(), packing.lower_bound(out.length.to_numpy(), 256))]
    clash = packing.pack(pieces.withColumns({"row": F.lit("a"), "offset": F.lit("b"), "sequence_id": F.lit("c")}), 256)
    assert clash.columns == [*pieces.columns, "row", "sequence_id", "offset"] and clash.where("row = 'a'").count() == len(out)
    assert packing.pack(packing.tokenised(none, TOKENIZER), 2048).count() == 0


def test_partitions_with_gaps_exchange(spark, monkeypatch):
    monkeypatch.setattr(packing, "_PART", 12)
    r = random.Random(4)
    rows = spark.createDataFrame([(i, r.randint(300, 1500)) for i in range(200)], "doc_id long, length long")
    out = packing.pack(rows).toPandas()
    bound = packing.lower_bound(out.length.to_numpy(), 2048)
    apart = sum(len(set(packing.best_fit_decreasing(out.length.to_numpy()[i : i + 12], 2048))) for i in range(0, 200, 12))
    assert len(out) == 200 and bound <= out.sequence_id.nunique() < apart


def test_lower_bound_never_exceeds_the_optimum():
    r = random.Random(9)
    for _ in range(300):
        n = r.randint(1, 7)
        sizes = [r.randint(1, 20) for _ in range(n)]
        best = [n]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == n:
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[i] <= 20:
                    bins[b] += sizes[i]
                    place(i + 1, bins)
                    bins[b] -= sizes[i]
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        assert packing.lower_bound(np.array(sizes), 20) <= best[0] <= len(set(packing.best_fit_decreasing(np.array(sizes), 20)))


def test_words_that_the_tokenizer_treats_apart():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, memo = Tokenizer.from_file(TOKENIZER), packing._Memo(TOKENIZER)
    for text in ("İstanbul. don't it's, x", "A<|endoftext|>b <|ENDOFTEXT|>", "ﬁne! Ångström; 12ab. ...", "日本語! a​b straße: C'ś", None, ""):
        want = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert memo.texts(pa.array([text], pa.string())) == [want]


def vectors(spark, n=400):
    r = np.random.default_rng(3)
    centre = r.normal(size=(20, 8))
    rows = [(i, [float(x) for x in centre[i % 20] + 0.08 * r.normal(size=8)], i % 3 if i % 11 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [float("nan")] * 8, 1), (n + 3, [None, 1.0] * 4, 1), (n + 4, [1.0], 1), (n + 5, rows[3][1], rows[3][2]), (n + 6, rows[3][1], rows[3][2])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).withColumn("node", F.lit(1))


def usable(v):
    return v is not None and len(v) == 8 and None not in v and np.isfinite(v).all()


def test_embedding_dedup(spark, monkeypatch):
    for name, n in (("_BLOCK", 16), ("_LEAF", 8), ("_FAN", 2), ("_TILE", 3)):
        monkeypatch.setattr(embedding_dedup, name, n)
    rows, df = vectors(spark)
    twice = embedding_dedup.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int"), cosine=0.97)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in twice.collect()) == [(1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, cosine=0.97).collect()}
    f32 = {i: np.array(v, np.float32).astype(float) for i, v, label in rows if label is not None and usable(v) and any(v)}
    label, links = {i: x for i, _, x in rows}, {i: set() for i, *_ in rows}
    for i, v in f32.items():
        for j, w in f32.items():
            if i != j and label[i] == label[j] and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.97:
                links[i].add(j)
    assert len(got) == len(rows)
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), i == min(seen))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "ROWS", 50)
    rows, df = vectors(spark)
    q = topk_search.quantised(df, "vec_id", "embedding", 64.0)
    assert topk_search.top_k(q.limit(0), q.limit(0)).count() == 0
    q = q.where("size(x) = 8")
    got = {}
    for r in topk_search.top_k(q, q.where("vec_id % 20 = 3 OR vec_id = 405"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = {i: np.floor(np.array(v, np.float32).astype(float) * 64).astype(int) for i, v, _ in rows if usable(v)}
    for i, found in got.items():
        want = sorted(((j, int(x[i] @ w)) for j, w in x.items() if j != i), key=lambda p: (-p[1], p[0]))[:10]
        assert found == want
    assert set(got) == {i for i in x if i % 20 == 3 or i == 405}


def test_topk_stops_early(spark):
    r = np.random.default_rng(1)
    weight = 0.5 ** np.arange(6)  # components that matter less and less
    x = np.floor(r.normal(size=(6000, 6)) * weight * 1024).astype(int)
    rows = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, x array<long>").repartition(4)
    asked = rows.where("vec_id % 500 = 0")
    scored = topk_search.searched(rows, asked, 10).agg(F.sum("scored")).first()[0]
    assert 0 < scored < 0.5 * 12 * 6000
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.top_k(rows, asked, 10).collect())
    want = [(i, k + 1, j, s) for i in range(0, 6000, 500) for k, (j, s) in enumerate(sorted(((j, int(x[i] @ x[j])) for j in range(6000) if j != i), key=lambda p: (-p[1], p[0]))[:10])]
    assert got == want


def test_url_filter(spark):
    urls = ["http://A.Net/x?q#f", "https://example.net/en/a", "http://m.example.net/en", "ftp://x.example.com/de/1#t", "http://b.org/fr/", "http://b.org/de/", "nothing", None, "", "http://a.net", "://net/", "http://listed.io/p/", "http://www.listed.io/p", "http://net.org/", "http://xexample.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit("clash"))
    listed = spark.createDataFrame([("listed.io/p",), (None,)], "url string")
    got = {r.page_id: r for r in url_filter.judged(pages, queries.RULES, listed).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits) if fits else None
        verdict = rule[2] if rule else "block" if host in ("listed.io", "www.listed.io") else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule and rule[1], verdict)


def test_blocked_bloom_filter(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = url_filter.bloom_blocks(keys, 125)
    asked = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    held = {r.key for r in url_filter.may_hold(asked, blocks, 125).collect()}
    assert {f"k{i}" for i in range(2000)} <= held and len(held) < 2000 + 0.02 * 18_000


def test_fixity(spark):
    rows = [(i, f"u{i}", None if i % 9 == 0 else "x" * (i * 37 % 5000)) for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = fixity.laid_out(pages, F.floor(F.col("page_id") / 40), ["page_id"], ["url", "html"])
    same = first.where("page_id >= 0")
    assert fixity.audit(first, same).count() == 0 and fixity.audit(first.limit(0), first.limit(0)).count() == 0
    second = first.where("page_id <> 7").withColumn("digest", F.when(F.col("page_id").isin(3, 500), "bad").otherwise(F.col("digest")))
    found = fixity.audit(first, second.unionByName(first.where("page_id = 20").withColumn("offset", F.lit(10**7))))
    named = {(r.page_id, r.status) for r in found.join(first, ["volume", "offset"], "left").select("page_id", "status").collect()}
    assert named == {(3, "changed"), (500, "changed"), (7, "missing"), (None, "extra")}


def test_sharding(docs, none):
    rows = docs.select("doc_id", "source")
    out = sharding.interleaved(rows, 8, 5).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == len(corpus()) and sizes.max() - sizes.min() <= 1
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in out.groupby("shard"))
    share = out.fillna("none").groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (share.max(axis=1) - share.min(axis=1)).max() <= 2
    again = sharding.interleaved(rows.repartition(5), 8, 5).toPandas()
    key = lambda d: sorted(zip(d.doc_id, d.shard, d.slot))
    assert key(out) == key(again) and sharding.interleaved(none.select("doc_id", "source")).count() == 0


def brute_shards(rows, shards, seed):
    by = {}
    for i, source in rows:
        h = hashlib.md5(f"{i}|{seed}".encode()).hexdigest()
        by.setdefault(source, []).append((h, i))
    order = sorted(((2 * k + 1) / (2 * len(v)), source or "", h, i) for source, v in by.items() for k, (h, i) in enumerate(sorted(v)))
    cut = [at * shards // len(order) for at in range(len(order))]
    return sorted((i, s, at - cut.index(s)) for at, ((_, _, _, i), s) in enumerate(zip(order, cut)))


def test_sharding_against_plain_sorting(docs, monkeypatch):
    monkeypatch.setattr(sharding, "_BUCKET", 7)
    rows = docs.select("doc_id", "source").withColumns({c: F.lit(777) for c in ("before", "rank", "shard", "slot", "n", "total", "bucket")})
    out = sharding.interleaved(rows, 8, 5)
    assert out.columns == [*(c for c in rows.columns if c not in ("shard", "slot")), "shard", "slot"] and out.where("rank = 777 AND before = 777").count() == len(corpus())
    assert sorted((r.doc_id, r.shard, r.slot) for r in out.collect()) == brute_shards([(r.doc_id, r.source) for r in docs.collect()], 8, 5)


def test_raking_meets_margins(spark, none):
    r = random.Random(2)
    cells = spark.createDataFrame([(a, b, r.randint(1, 1000)) for a in "xyz" for b in "pq"], "a string, b string, tokens long")
    targets = {"a": {"x": 0.5, "y": 0.3, "z": 0.2}, "b": {"p": 0.6, "q": 0.4}}
    fit = mixing.raked(cells, targets).toPandas()
    assert fit.residual.max() <= mixing.TOLERANCE
    torn = spark.createDataFrame([("x", "p", 5), ("y", "q", 7)], "a string, b string, tokens long")  # no weights meet these
    assert mixing.raked(torn, {"a": {"x": 0.5, "y": 0.5}, "b": {"p": 0.9, "q": 0.1}}).toPandas().residual.max() > 0.1
    mass = fit.tokens * fit.probability
    for d, goal in targets.items():
        for k, v in goal.items():
            assert mass[fit[d] == k].sum() / mass.sum() == pytest.approx(v, abs=1e-6)
    assert fit.probability.max() == pytest.approx(1)
    assert mixing.mixture(none.withColumn("topic", F.lit(None).cast("string")), queries.TARGETS).count() == 0


def test_mixture_keeps_rows_and_clashing_columns(docs):
    rows = docs.withColumn("topic", F.lit("1"))
    out = mixing.mixture(rows.withColumn("probability", F.lit(1)), queries.TARGETS)
    assert out.count() == len(corpus()) and out.columns[: len(rows.columns)] == rows.columns and out.where("probability = 1").count() == len(corpus())
    assert out.where("doc_id = 93 AND n_tokens__ <> 2").count() == 0


def toxic_corpus(n=600):
    r, rows, labels = random.Random(5), [], []
    for i in range(n):
        words = ["".join(r.choice(["an", "er", "th", "in", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            words[r.randrange(len(words))] = "zorg" + r.choice(["ist", "el", "um"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*labels, (5, None), (9001, 7)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, marks).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (y == 1) for i, y in held)
    assert right >= 0.95 * len(held) and len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values())
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.scored(docs, flipped.unionByName(marks.where("doc_id > 600"))).collect()}
    assert got == pytest.approx(again)  # held-out labels are never seen
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("clash")), marks)
    assert kept.columns == ["doc_id", "text", "score"] and 0.7 * len(rows) < kept.count() < 0.85 * len(rows)


def brute_toxicity(rows, labels):
    """Beginnings of words in dictionaries: every one counts, and the curve sees all rows of its fold."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    spell = lambda w: [(w.encode() + b"\2")[:k] for k in range(1, min(len(w.encode()) + 1, 12) + 1)]
    counts, mark = {}, dict(labels)
    for i, text in rows:
        for g in (g for w in text.split() for g in spell(w) if i in mark and fold(i) not in (0, 4)):
            counts.setdefault(g, [0, 0])[1 - mark[i]] += 1
    after = {}
    for g in counts:
        after.setdefault(g[:-1], []).append(g)

    def part(h, g, of, less):
        total = sum(of(x) for x in after[h])
        left = 1 - sum(max(of(x) - less, 0) for x in after[h]) / total
        return (max(of(g) - less, 0) / total if g in counts else 0.0), left

    def value(g):
        h = g[:-1]
        if not all(sum(counts[x][k] for x in after.get(h, [])) for k in (0, 1)):
            return 0.0
        own, left = part(h, g, lambda x: sum(counts[x]), 0.75)
        shared = own + left / 256
        (t, left_t), (c, left_c) = (part(h, g, lambda x, k=k: counts[x][k], 3.0) for k in (0, 1))
        return float(np.log(t + left_t * shared) - np.log(c + left_c * shared)) if g in counts else float(np.log(left_t) - np.log(left_c))

    seen = {}
    words = [[seen.setdefault(w, None) if seen.get(w) is not None else seen.update({w: sum(map(value, spell(w)))}) or seen[w] for w in text.split()] for _, text in rows]
    x = np.array([[1.0, np.mean(v), np.mean(sorted(v)[-3:])] for v in words])
    held = np.array([i in mark and fold(i) == 4 for i, _ in rows])
    y, scale, w = np.array([mark[i] for i, _ in rows if i in mark and fold(i) == 4]), np.array([1, *x[held, 1:].std(0)]), np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x[held] / scale @ w, -30, 30)))
        w = w + np.linalg.solve((x[held] / scale).T * (q * (1 - q)) @ (x[held] / scale) + 1e-3 * np.eye(3), (x[held] / scale).T @ (y - q) - 1e-3 * w)
    return dict(zip([i for i, _ in rows], 1 / (1 + np.exp(-np.clip(x / scale @ w, -30, 30)))))


@pytest.mark.parametrize("held", [1 << 40, 0])
def test_toxicity_counts_every_ngram(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "HELD", held, raising=False)  # broadcast, and joined
    monkeypatch.setattr(toxicity, "_ADDED", 200)  # counts are handed on in parts
    rows, labels = toxic_corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got == pytest.approx(brute_toxicity(rows, labels), abs=1e-6)


def test_toxicity_of_a_large_model_meets_texts_in_parts(spark, monkeypatch):
    """No row on the way grows with a batch of texts, and many small parts give the scores of one whole model."""
    kinds, written = [], toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: kinds.extend(k for _, k in df.dtypes) or written(df, name))
    monkeypatch.setattr(toxicity, "HELD", 0)
    monkeypatch.setattr(toxicity, "_LEAST", 200, raising=False)
    rows, labels = toxic_corpus(200)
    rows += [(900, "ab é zz"), (901, "a"), (902, ""), (903, None), (904, "abzz abyy zzab"), (904, "abzz abyy zzab"), (904, "other text")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    in_parts = sorted(tuple(r) for r in toxicity.scored(docs, marks).collect())
    assert "binary" not in kinds
    monkeypatch.setattr(toxicity, "HELD", 1 << 40)
    whole = sorted(tuple(r) for r in toxicity.scored(docs, marks).collect())
    assert [i for i, _ in in_parts] == [i for i, _ in whole] and len(whole) == len(rows)
    assert [x for _, x in in_parts] == pytest.approx([x for _, x in whole], abs=1e-9)


def test_toxicity_finds_stems_in_every_language(spark):
    """Insults that are stems with endings of their own, in texts of four kinds where parts of the stems are common letters."""
    r = random.Random(11)
    kinds = [("achlich", ["ach", "lich", "keit", "ung", "en", "und", "die"]), ("réeux", ["ré", "eux", "ment", "pa", "é", "la", "oi"]), ("boment", ["bo", "ment", "ción", "os", "de", "ra", "que"]), ("idiot", ["id", "io", "the", "ing", "of", "and", "tion"])]
    kinds = [(stem, parts + ["".join(r.choice("aeioulnrst") for _ in range(3)) for _ in range(18)]) for stem, parts in kinds]
    rows, labels = [], []
    for i in range(1600):
        stem, parts = r.choice(kinds)
        words = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.choice([30, 200]))]
        bad = r.random() < 0.25
        for _ in range(max(4, len(words) // 40) if bad else r.random() < 0.1):
            words[r.randrange(len(words))] = stem + "".join(r.choice(parts) for _ in range(r.randint(1, 2)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(got[i] >= 0.5, y, i) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    toxic, clean = [p for p, y, _ in held if y], [p for p, y, _ in held if not y]
    assert len(toxic) > 50 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.05 * len(clean)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_on_the_test_tables(spark):
    """Held-out labels, over all and by language."""
    sf = "/root/testdata/sf0.1"
    found = queries.op10_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic IS NOT NULL").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.select("lang", "toxic", "predicted").collect()
    for lang in (None, "en", "de", "fr", "es"):
        toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == y and lang in (None, r["lang"])] for y in (1, 0))
        assert sum(toxic) >= (0.9 if lang is None else 0.8) * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert [round(r.score, 6) for r in toxicity.scored(docs, empty).collect()] == [0.0, 0.0]
    assert toxicity.scored(docs.limit(0), empty).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_corpus(200)
    base = corpus(40, 8)
    texts = [(i, t, "en", "src0", len(t)) for i, t in rows] + [(1000 + i, t, lang, s, n) for i, t, lang, s, n in base]
    spark.createDataFrame(texts, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, [1.0], i % 10) for i in range(100)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        seen.append(docs.count())
        if name == "line_dedup":
            want = brute_lines([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id: r.text for r in docs.collect()} == want
        if name == "ngram_join":
            want = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in want.items() if i == c}
        if name != "packing":
            assert docs.columns == before.columns
        else:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    digest = lambda df: sorted(map(str, df.drop("sequence_id", "offset").collect()))
    assert digest(corpus_pipeline.run(spark, str(tmp_path))) == digest(docs)
