"""Language, spelling variants and periodic runs against brute force, with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm import language_id, periodic_runs, queries, spelling, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    return df.withColumns({n: F.lit("clash") for n in ("word", "n", "key", "id", "runs", "collapsed", "lang_pred", "h", "piece", "root", "form")})


def brute_runs(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - a + q >= max(least, times * q):
                out.append((a, i - a + q, q))
            i += 1
    return sorted(r for r in out if not any(q < r[2] and a <= r[0] and a + n >= r[0] + r[1] for a, n, q in out))


def some_words(r):
    w = [bytes([97 + r.randrange(r.choice([1, 2, 3]))]) for _ in range(r.randint(0, 40))]
    if w and r.random() < 0.7:
        a, p = r.randrange(len(w)), r.randint(1, 8)
        w = w[:a] + [w[min(len(w) - 1, a + i % p)] for i in range(r.randint(4, 50))] + w[a:]
    return w * r.choice([1, 1, 1, 2, 3])


def test_runs_equal_all_periods_tried():
    r = random.Random(7)
    for _ in range(1500):
        w = some_words(r)
        assert periodic_runs.runs_of(w) == brute_runs(w)
        assert periodic_runs.runs_of(w, 2, 2) == brute_runs(w, 2, 2)
        assert periodic_runs.runs_of(w, 3, 3) == brute_runs(w, 3, 3)


def test_hashes_that_collide_are_found_out():
    """Polynomial hashes of 64 bits cannot tell a long Thue-Morse word from its complement."""
    tm = [b"ab"[bin(i).count("1") % 2 :][:1] for i in range(1 << 12)]
    codes = [int(x == b"b") for x in tm]
    flipped = [1 - c for c in codes]
    same = periodic_runs.Extensions([*codes, 2, *codes[:2048], 3, *flipped[:2048], -1])
    assert same._same(len(codes) + 1, len(codes) + 2050, 2048)
    assert same.after(0, len(codes) + 1) == 2048
    assert same.after(len(codes) + 1, len(codes) + 2050) == 0
    assert periodic_runs.runs_of(tm * 5 + tm[:2048]) == brute_runs(tm * 5 + tm[:2048])


def test_long_periodic_texts_are_quick():
    assert periodic_runs.runs_of([b"a"] * 100_000) == [(0, 100_000, 1)]
    assert periodic_runs.runs_of(b"long words here".split() * 30_000) == [(0, 90_000, 3)]


def planted(i, w):
    h = zlib.crc32(str(i).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_periodic_runs_query(spark, tmp_path):
    r = random.Random(5)
    rows = [[i, "\t".join(x.decode() for x in some_words(r)) + r.choice(["", "\n ", " é b"]), "en", "s", 0] for i in range(150)]
    rows += [[150, None, None, None, None], [151, "", None, None, 0], [152, "A a " * 5000, None, None, 0], [3, rows[3][1], None, None, 0], [None, "a a a a a a a", None, None, 0]]
    clashing(spark.createDataFrame(rows, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text, *_ in rows:
        if i is None:
            continue
        w = planted(i, (text or "").encode().split())
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(x[1] for x in want) > 100


def test_collapsed_gives_spans_and_texts(spark):
    rows = spark.createDataFrame([("x", "so it it it it it it is"), ("y", None)], "name string, body string")
    got = {r["name"]: r for r in periodic_runs.collapsed(rows, "name", "body").collect()}
    assert [tuple(x) for x in got["x"]["runs"]] == [(1, 6, 1)] and got["x"]["collapsed"] == "so it is"
    assert got["y"]["runs"] == [] and got["y"]["collapsed"] == ""


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(n, times):
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= times * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def test_grouped_equals_all_pairs(spark):
    r = random.Random(2)
    n = {"".join(r.choice("abé") for _ in range(r.randint(1, 7))): r.choice([5, 5, 6, 30, 200, 1500]) for _ in range(500)}
    n |= {"x" * 5000: 7, "x" * 4999: 40, "x" * 2500 + "y" + "x" * 2500: 300, "aabb": 1, "abab": 5}
    words = spark.createDataFrame(list(n.items()), "word string, n long").withColumn("form", F.lit(1))
    got = spelling.grouped(words, 5).select("word", "form", "root", "n", "n_near", "form_n")
    want = brute_forms(n, 5)
    assert sorted(map(tuple, got.collect())) == want
    assert max(sum(a[1] == b[0] for b in want) for a in want) and any(a[2] != a[1] for a in want if a[1])  # chains occur
    pairs = spelling.near_words(words.select("word", "n"))
    assert pairs.count() == pairs.select("word", "near").distinct().count() == sum(x[4] for x in want)


def test_spelling_query(spark, tmp_path):
    r = random.Random(4)
    stems = ["".join(r.choice("abcdeÀÉé") for _ in range(8)) for _ in range(30)]
    rows = [[i, " ".join(r.choice(stems).capitalize() + r.choice(["", "", "s", "×2", ".", "Ω"]) for _ in range(r.randint(1, 200))), None, None, 0] for i in range(120)]
    rows += [[120, None, None, None, 0], [121, "", None, None, 0], [5, rows[5][1], None, None, 0], [None, "abcdefgh " * 9, None, None, 0], [122, "q" * 20000 + " ", None, None, 0]] + [[123 + k, "q" * 19999, None, None, 0] for k in range(5)]
    clashing(spark.createDataFrame(rows, DOCS)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    n = Counter()
    for i, text, *_ in rows:
        if i is not None:
            for w in spelling._WORD.findall((text or "").encode().lower().decode()):
                h = zlib.crc32(f"{i}:{w}".encode())
                n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    want = brute_forms({w: k for w, k in n.items() if len(w) >= 6 and k >= 5}, 5)
    got = queries.op12_spelling(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == want and any(x[1] for x in want)


def phrases(sample, text):
    """Longest matches by search, from stretch to stretch."""
    n = 0
    for a in range(0, len(text), language_id.STRETCH):
        part, k = text[a : a + language_id.STRETCH], 0
        while k < len(part):
            size = 1
            while k + size < len(part) and part[k : k + size + 1] in sample:
                size += 1
            k, n = k + (size if part[k : k + size] in sample else 1), n + 1
    return n


def test_phrases_are_the_longest_matches():
    r = random.Random(9)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 5)))
    samples = {k: language_id.plain(" ".join(word(v) for _ in range(400))) for k, v in {"a": "abc", "b": "bcdé", "c": "aé"}.items()}
    model = []
    for k, s in samples.items():
        moves = language_id.automaton(s)
        flat = [(q, b, t) for q, out in enumerate(moves) for b, t in out.items()]
        model.append((k, len(s), len(moves), language_id.np.array(flat, "int32").tobytes()))
    parsers = language_id.Parsers(model)
    texts = [language_id.plain(" ".join(word("abcdeéxyz") for _ in range(r.randint(1, 900)))) for _ in range(20)] + [b" a ", b" zz ", language_id.plain("ab " * 900)]
    got = parsers.phrases(texts)
    assert got.T.tolist() == [[phrases(s, t) for s in samples.values()] for t in texts]


def test_language_query(spark, tmp_path):
    r = random.Random(3)
    kinds = {"en": ["the", "and", "thing", "ofth", "with"], "de": ["der", "und", "schen", "über", "mit"], "fr": ["les", "été", "eaux", "une", "que"]}
    rows = []
    for i in range(300):
        k = r.choice(list(kinds))
        rows.append([i, " ".join("".join(r.choice(kinds[k]) for _ in range(r.randint(1, 3))) for _ in range(r.choice([2, 20, 400]))), k if r.random() < 0.9 else None, "s", 0])
    rows += [[300, None, "en", None, 0], [301, "", "de", None, 0], [302, "12 345 ...", "de", None, 0], [303, "THE AND", None, None, 0], [7, rows[7][1], None, None, 0], [None, "the and", "en", None, 0]]
    clashing(spark.createDataFrame(rows, DOCS)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) - 1
    lang = {r["doc_id"]: r["lang_pred"] for r in got}
    assert {lang[i] for i in (300, 301, 302)} == {"und"} and lang[303] == "en"
    held = [(r["lang_pred"], rows[r["doc_id"]][2]) for r in got if r["held_out"] and r["doc_id"] < 300 and rows[r["doc_id"]][2]]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_the_sample_is_bounded_and_order_does_not_matter(spark):
    rows = spark.createDataFrame([(i, f"word{i % 700} text" * 300, "en" if i % 3 else "de") for i in range(400)], "doc_id long, text string, lang string")
    a = {r["lang"]: r for r in language_id.learned(rows, sample=4096).collect()}
    b = {r["lang"]: r for r in language_id.learned(rows.repartition(7, F.rand(1)), sample=4096).collect()}
    assert a == b and all(2048 < r["n_bytes"] <= 4096 + language_id.PIECE + 1 for r in a.values())


@pytest.mark.parametrize("query", ["op11_language_id", "op12_spelling", "op13_periodic_runs"])
def test_empty_tables(spark, tmp_path, query):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[query](spark, str(tmp_path)).count() == 0


def test_nothing_learned_is_und(spark):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    got = language_id.predicted(rows, language_id.learned(rows.where(toxicity.fold("doc_id") != 9))).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_spelling_joins_build_no_table_on_the_driver(spark):
    """Small files hold many words: at half a gigabyte of text a broadcast of their deletions did not fit the driver."""
    words = spark.createDataFrame([("example", 90), ("exampel", 1), ("exmple", 2), ("samples", 7), ("sample", 50)], "word string, n long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        for found in (spelling.near_words(words), spelling.grouped(words)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
            found.collect()
            assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
