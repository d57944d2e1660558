"""The registered queries of this package, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import embedding_dedup, fixity, language_id, line_dedup, mixing, ngram_join, packing, periodic_runs, sharding, spelling, topk_search, toxicity, url_filter
from larkspur.llm.common import written

#: Host, path prefix and verdict of the URL rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Pages of a volume of the archive; rows of the replica that are damaged and lost, by remainder of the page id.
VOLUME, DAMAGED, LOST, LISTED = 512, (211, 5), (503, 7), 97
#: Target shares of tokens: every source and language by name, and a little for others. Topics are the labels of the
#: documents' embeddings, `other` where there is none.
TARGETS = {
    "source": {"src0": 0.2, **{f"src{k}": 0.041 for k in range(1, 20)}, "other": 0.021},
    "lang": {"en": 0.54, "de": 0.17, "fr": 0.16, "es": 0.11, "other": 0.02},
    "topic": {**{str(k): 0.02 for k in range(10)}, "other": 0.8},
}
#: Rounds of raking that the SQL unrolls: more than the fit takes to settle.
ROUNDS, SEED = 40, 17
#: Words that spelling variants are sought among: least letters and occurrences, every how many lose a letter, and how much
#: more frequent a form is.
SHORTEST, RAREST, DROPPED, TIMES = 6, 5, 199, 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its place in the archive and what the audit of a damaged replica says of it.

    The replica is the archive itself with planted damage: some records rotted in place, some lost.
    """
    pages = _table(spark, sf_dir, "pages")
    first = written(fixity.laid_out(pages, F.floor(F.col("page_id") / VOLUME), ["page_id"], ["url", "html"]), "archive")
    rotted = F.when(F.pmod("page_id", F.lit(DAMAGED[0])) == DAMAGED[1], F.sha2(F.concat("digest", F.lit("!")), 256)).otherwise(F.col("digest"))
    second = first.where(F.pmod("page_id", F.lit(LOST[0])) != LOST[1]).withColumn("digest", rotted)
    found = fixity.audit(first, second)
    return first.join(found, ["volume", "offset"], "left").select("page_id", "volume", "offset", "size", "digest", F.coalesce("status", F.lit("intact")).alias("status"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page; the list stands in for a supplied one: canonical URLs of every 97th page id."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.col("page_id") % LISTED == 0).where(url_filter.host(F.col("url")) != "").select(url_filter.canonical(url_filter.host(F.col("url")), url_filter.path(F.col("url"))).alias("url"))
    return url_filter.judged(pages, RULES, listed)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").where("vec_id is not null").groupBy(F.col("vec_id").alias("topic_id")).agg(F.min("label").cast("string").alias("topic"))


def mixed(docs: DataFrame, spark: SparkSession, sf_dir: str, targets: dict[str, dict[str, float]]) -> DataFrame:
    """(doc_id, source, lang, topic, ..., stays__): texts are counted before the join, so that no text is shuffled."""
    narrow = docs.select("doc_id", "source", "lang", mixing.tokens("text").alias("n_tokens"))
    rows = written(narrow.join(topics(spark, sf_dir), F.col("doc_id") == F.col("topic_id"), "left").drop("topic_id"), "counted")
    return mixing.mixture(rows, targets, seed=SEED, tokens_col="n_tokens")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, tokens and probability, and whether it stays. Null or unnamed categories and documents without
    an embedding are `other`; empty and null texts have no tokens; rows that repeat an id stay or go together."""
    rows = mixed(_table(spark, sf_dir, "documents"), spark, sf_dir, TARGETS)
    return rows.select("doc_id", *(f"cell_{d}" for d in TARGETS), "n_tokens", F.round("probability__", 6).alias("probability"), F.col("stays__").alias("stays"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null vectors, those with null or non-finite components and rows without an id take no part; ties go to smaller ids."""
    rows = topk_search.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024.0)
    return topk_search.top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its place, and the number of sequences with the least that is proven possible (a gap is not hidden).

    Null and empty texts are the end id alone; rows without an id and repeated rows are packed each."""
    pieces = packing.tokenised(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    packed = written(packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), "packed")
    proof = packing.certificate(packed).first() or (0, 0)
    return packed.withColumns({"bins": F.lit(proof[0]).cast("long"), "bound": F.lit(proof[1]).cast("long")})


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are null or without words link with nothing; rows without an id are left out; equal sets always link."""
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text is one empty line; rows without an id are left out; a shared line stays in the smallest id."""
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("n_lines__").alias("n_lines"), F.col("n_dropped__").alias("n_dropped"), F.sha2("kept__", 256).alias("kept_sha256"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that cannot link (null, zero, not finite, without a label) form components of their own; rows without an id
    are left out, as neither their links nor their class could be named; a repeated row is one more vector."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have size 1; a null source is a source of its own; rows without an id and repeated rows are placed too."""
    text = F.col("text")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    placed = sharding.interleaved(rows, 8, SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts score the base rate of the labels; rows without an id are left out; equal texts score alike."""
    scores = toxicity.scored(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (toxicity.fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automata of the rows outside fold 0 whose language is known, then every text judged. Null texts and those without a
    letter are `und`; rows without an id are left out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where("doc_id IS NOT NULL")
    model = language_id.learned(docs.where(toxicity.fold("doc_id") != 0))
    return language_id.predicted(docs, model).select("doc_id", (toxicity.fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "bits")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters and five occurrences or more, with planted misspellings; null and empty texts have no words."""
    words = spelling.counted(_table(spark, sf_dir, "documents"), shortest=SHORTEST, drop_every=DROPPED)
    return spelling.grouped(words.where(F.col("n") >= RAREST), TIMES)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, with every tenth document turned periodic; null texts have no words; equal texts of other ids may
    differ, as what is planted depends on the id."""
    docs = _table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    found = periodic_runs.collapsed(docs.select("doc_id", periodic_runs.with_planted("doc_id", "text").alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    longest = (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), F.expr("1000 * b.length DIV -b.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", *longest, "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_merkle_fixity, op2_url_filter, op3_mixing, op4_topk_search, op5_packing, op6_ngram_join, op7_line_dedup, op8_embedding_dedup, op9_sharding, op10_toxicity, op11_language_id, op12_spelling, op13_periodic_runs)}

_FIXITY = f"""
WITH r AS (SELECT page_id, page_id // {VOLUME} AS volume, (64 + coalesce(octet_length(encode(url)), 0) + coalesce(octet_length(encode(html)), 0))::BIGINT AS size,
  sha256(concat_ws('|', coalesce(octet_length(encode(url)) || ':' || url, '-'), coalesce(octet_length(encode(html)) || ':' || html, '-'))) AS digest FROM pages WHERE page_id IS NOT NULL)
SELECT page_id, volume, coalesce(sum(size) OVER (PARTITION BY volume ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", size, digest,
  CASE WHEN page_id % {LOST[0]} = {LOST[1]} THEN 'missing' WHEN page_id % {DAMAGED[0]} = {DAMAGED[1]} THEN 'changed' ELSE 'intact' END AS status FROM r"""

_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_URLS = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/$', '') AS url FROM p),
rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
l AS (SELECT DISTINCT url FROM c WHERE page_id % {LISTED} = 0 AND host <> ''),
j AS (SELECT c.*, (SELECT max(struct_pack(n := length(h || rules.p), r := h || rules.p, v := v)) FROM rules WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, rules.p)) AS best,
  (host <> '' AND url IN (SELECT url FROM l)) AS listed FROM c)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j"""


def _mixing_sql(targets: dict[str, dict[str, float]], rounds: int, documents: str = "documents") -> str:
    """The raking unrolled: three windows a round over the cells."""
    dims = list(targets)
    cell = {d: f"CASE WHEN {d} IN ({', '.join(repr(k) for k in t if k != 'other')}) THEN {d} ELSE 'other' END" for d, t in targets.items()}
    goal = {d: "CASE " + " ".join(f"WHEN cell_{d} = '{k}' THEN {v!r}::DOUBLE" for k, v in t.items()) + " ELSE 0.0 END" for d, t in targets.items()}
    cells = ", ".join(f"cell_{d}" for d in dims)
    out = [
        f"d0 AS (SELECT doc_id, source, lang, topic, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM {documents} LEFT JOIN (SELECT vec_id, min(label)::VARCHAR AS topic FROM embeddings WHERE vec_id IS NOT NULL GROUP BY 1) ON doc_id = vec_id)",
        f"d AS (SELECT doc_id, n_tokens, {', '.join(f'{c} AS cell_{x}' for x, c in cell.items())} FROM d0)",
        f"c AS (SELECT {cells}, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY {cells} HAVING sum(n_tokens) > 0)",
        f"g0 AS (SELECT *, {', '.join(f'{goal[x]} / count(*) OVER (PARTITION BY cell_{x}) AS share_{x}, {goal[x]} AS goal_{x}' for x in dims)} FROM c)",
        f"w0 AS MATERIALIZED (SELECT {cells}, tokens, tokens AS w, {', '.join(f'CASE WHEN sum(share_{x}) OVER () > 0 THEN goal_{x} / sum(share_{x}) OVER () ELSE 1.0 END AS goal_{x}' for x in dims)} FROM g0)",
    ]
    n = 0
    for _ in range(rounds):
        for x in dims:
            total = f"sum(w) OVER (PARTITION BY cell_{x} ORDER BY {cells} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            out.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {total} > 0 THEN w * goal_{x} / {total} ELSE 0.0 END AS w) FROM w{n})")
            n += 1
    out.append(f"p AS (SELECT {cells}, CASE WHEN max(w / tokens) OVER () > 0 THEN w / tokens / max(w / tokens) OVER () ELSE 1.0 END AS p FROM w{n})")
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, {", ".join(f"d.cell_{x}" for x in dims)}, n_tokens, round(coalesce(p, 1.0), 6) AS probability,
  (('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), '{SEED}')), 1, 13))::BIGINT / 4503599627370496.0) < coalesce(p, 1.0) AS stays
FROM d LEFT JOIN p ON {" AND ".join(f"d.cell_{x} = p.cell_{x}" for x in dims)}"""


_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score FROM v AS q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, (first IS NOT NULL AND doc_id <> first) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

#: CRC-32 by table, a byte at a time; shards by fractional ranks.
_SHARDS = f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
d AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size, list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS x FROM documents),
b AS (SELECT doc_id, source, size, CASE WHEN size = 1 THEN [] ELSE list_transform(range(1, len(x), 2), lambda i: (16 * x[i] + x[i + 1])::BIGINT) END AS x FROM d),
c AS (SELECT doc_id, source, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, x), lambda a, y: xor(a // 256, t[xor(a, y) % 256 + 1]))) AS text_crc32, md5(concat_ws('|', doc_id::VARCHAR, '{SEED}')) AS h FROM b, t),
r AS (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY source) AS m, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST) AS i FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY (2 * i - 1) / (2 * m), source NULLS FIRST, h, doc_id NULLS FIRST) - 1 AS p FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 8 // n)::INTEGER AS shard, (p - ceil((p * 8 // n) * n / 8))::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM o"""

#: All pairs of sets that share a shingle, and what their links reach.
_NGRAMS = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), k AS (SELECT g, row_number() OVER () AS k FROM s GROUP BY g HAVING count(*) > 1), h AS MATERIALIZED (SELECT doc_id, k FROM s JOIN k USING (g)),
i AS (SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS shared FROM h a JOIN h b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
m AS MATERIALIZED (SELECT one, two FROM i JOIN n x ON x.doc_id = one JOIN n y ON y.doc_id = two WHERE 100 * shared >= 85 * (x.n + y.n - shared)), l AS (SELECT one, two FROM m UNION ALL SELECT two, one FROM m),
r AS (SELECT doc_id AS id, doc_id AS place FROM t UNION SELECT r.id, l.two FROM r JOIN l ON r.place = l.one)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(place) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id"""
#: All pairs of vectors of a label, and what their links reach.
_NEAR = """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL),
u AS (SELECT * FROM (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE n > 0),
l AS (SELECT a.vec_id AS one, b.vec_id AS two FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS place FROM e UNION SELECT r.id, l.two FROM r JOIN l ON r.place = l.one), c AS (SELECT id, min(place) AS component_id FROM r GROUP BY id), d AS (SELECT one, count(*) AS links FROM l GROUP BY one)
SELECT id AS vec_id, coalesce(links, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN d ON one = id"""
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t"


def _crc(bytes_: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda a, y: xor(a // 256, t[xor(a, y) % 256 + 1])))"


#: Letters beyond ASCII as single bytes, so that edits of bytes are edits of letters.
_ACCENTS = "".join(map(chr, range(0xC0, 0x100)))
_SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.islower() and c != "'")[: len(_ACCENTS)]
#: All pairs of words of like length by plain edit distance.
_VARIANTS = rf"""WITH RECURSIVE t AS ({_CRC_TABLE}),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, w, count(*) AS n FROM o GROUP BY ALL), x AS (SELECT w, n, list_transform(string_split(hex(encode(doc_id::VARCHAR || ':' || w)), ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS x FROM p),
h AS (SELECT w, n, {_crc("list_transform(range(1, len(x), 2), lambda i: (16 * x[i] + x[i + 1])::BIGINT)")} AS h FROM x, t),
c AS (SELECT CASE WHEN h % {DROPPED} = 0 THEN substring(w, 1, (h % length(w))::BIGINT) || substring(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n, translate(word, '{_ACCENTS}', '{_SIGNS}') AS spelled FROM c WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {RAREST}),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM v a, v b WHERE a.word <> b.word AND abs(length(a.spelled) - length(b.spelled)) <= 1 AND levenshtein(a.spelled, b.spelled) = 1),
s AS (SELECT word, n, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY ALL),
f AS MATERIALIZED (SELECT s.word, min(near.near) AS form, s.top AS form_n FROM s JOIN near ON near.word = s.word AND near.near_n = s.top WHERE s.top >= {TIMES} * s.n GROUP BY ALL),
r AS (SELECT word, form AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root), e AS (SELECT word, root FROM r WHERE root NOT IN (SELECT word FROM f))
SELECT v.word, f.form, coalesce(e.root, v.word) AS root, v.n, coalesce(s.n_near, 0) AS n_near, f.form_n FROM v LEFT JOIN s ON s.word = v.word LEFT JOIN f ON f.word = v.word LEFT JOIN e ON e.word = v.word"""

#: Equal words of a document by distance, their unbroken stretches, and those that no stretch of a smaller distance holds.
_RUNS = rf"""WITH t AS ({_CRC_TABLE}),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} AS h FROM documents, t WHERE doc_id IS NOT NULL),
g AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d), q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(0, n - a), lambda i: w[a + i % p + 1])) ELSE w END AS w FROM q),
x AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM w),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM x JOIN x AS y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
r AS MATERIALIZED (SELECT doc_id, min(i) AS s, count(*) + q AS l, q FROM k GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
m AS MATERIALIZED (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
b AS (SELECT doc_id, count(*) AS n_runs, max(struct_pack(l := l, s := -s, q := -q)) AS b, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS h FROM m GROUP BY doc_id),
c AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS h FROM x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = x.doc_id AND x.i >= m.s + m.q AND x.i < m.s + m.l) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -b.s AS start, b.l AS length, -b.q AS period, 1000 * b.l // -b.q AS exponent_milli, coalesce(b.h, sha256('')) AS runs_sha256, coalesce(c.h, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""
ORACLES: dict[str, str] = {"op1_merkle_fixity": _FIXITY, "op2_url_filter": _URLS, "op3_mixing": _mixing_sql(TARGETS, ROUNDS), "op4_topk_search": _TOPK, "op6_ngram_join": _NGRAMS, "op7_line_dedup": _LINES, "op8_embedding_dedup": _NEAR, "op9_sharding": _SHARDS, "op12_spelling": _VARIANTS, "op13_periodic_runs": _RUNS}
