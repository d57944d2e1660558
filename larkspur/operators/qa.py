"""Question-answer datasets: citation checks, reversal, allocation, splits, edges and chat exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import Closeness, first_number, partial_ratio_udf

#: Weight of a question type in a knowledge edge.
TYPE_WEIGHTS = {"FACTUAL": 0.9, "RELATIONSHIP": 0.8, "MULTI_HOP": 0.6, "HIERARCHICAL": 0.7, "COMPARATIVE": 0.7, "REVERSAL": 0.5}


def segments(answer: Column, least: int = 20, head: int = 50, first: int = 100) -> Column:
    """The heads of sentences of at least `least` characters, and the start of the first sentence."""
    parts = F.filter(F.transform(F.split(answer, r"\. "), lambda x: F.trim(x)), lambda s: F.length(s) >= least)
    heads = F.transform(parts, lambda s: F.substring(s, 1, head))
    start = F.substring(F.element_at(F.split(answer, r"\. "), 1), 1, first)
    return F.array_distinct(F.filter(F.array_append(heads, start), lambda s: F.length(s) > 0))


def citation_scores(pairs: DataFrame, blocks: DataFrame, key: str, answer: str, block: str, on: str | None = None, floor: float = 0.0) -> DataFrame:
    """(key, score, segment): the best partial ratio of an answer's segments with blocks of its document (`on`).

    Segments that a block contains score 100 in built-in expressions; only the rest reach the Arrow UDF.
    """
    seg = pairs.select(key, *([on] if on else []), F.explode(segments(F.col(answer))).alias("segment"))
    text = blocks.select(*([on] if on else []), F.col(block).alias("block__"))
    both = seg.join(text, on) if on else seg.crossJoin(F.broadcast(text))  # without `on`, blocks are one document's
    whole = F.when(F.col("block__").contains(F.col("segment")), F.lit(100.0))
    exact = both.groupBy(key, "segment").agg(F.max(whole).alias("exact"))
    rest = both.join(exact.where("exact IS NULL").select(key, "segment"), [key, "segment"], "left_semi").groupBy(key, "segment").agg(F.max(partial_ratio_udf(F.col("segment"), F.col("block__"))).alias("fuzzy"))
    scored = exact.join(rest, [key, "segment"], "left").withColumn("score", F.coalesce("exact", "fuzzy"))
    return scored.where(F.col("score") >= floor).groupBy(key).agg(F.max("score").alias("score"), F.min_by("segment", F.struct(-F.col("score"), "segment")).alias("segment"))


#: Pairs of words that are sent to every text.
_PAIRS = 10_000


def quoted(segments: DataFrame, texts: DataFrame, segment: str, key: str, text: str) -> DataFrame:
    """segments' rows that some text (key, text) holds word for word.

    The second and third word of a segment stand whole in a text that holds it, so an equi-join on such pairs of words
    finds the texts to compare in full. Where few pairs are asked for (`_PAIRS`, counted), each text keeps only those of its own
    before they become rows. Segments of fewer than four words, a stated few, are looked for in every text.
    """
    words = F.split(F.col(segment), " ", -1)
    pair = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))
    long = segments.where(F.size(words) > 3).withColumn("pair__", pair(words, F.lit(1)))
    short = segments.where(F.size(words) <= 3)
    spoken = texts.select(F.col(key).alias("key__"), F.split(F.col(text), " ", -1).alias("w")).where(F.size("w") > 1)
    said = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    wanted = long.select("pair__").distinct()
    if wanted.count() <= _PAIRS:
        spoken = spoken.crossJoin(F.broadcast(wanted.agg(F.collect_list("pair__").alias("wanted__"))))  # one row
        said = F.array_intersect(said, F.col("wanted__"))
    spoken = spoken.select("key__", F.explode(F.array_distinct(said)).alias("pair__"))
    near = long.join(spoken.join(long.select("pair__").distinct(), "pair__", "left_semi"), "pair__")
    found = near.join(texts.select(F.col(key).alias("key__"), F.col(text).alias("text__")), "key__").where(F.col("text__").contains(F.col(segment))).select(segments.columns)
    if short.isEmpty():
        return found
    return found.unionByName(texts.join(short, F.col(text).contains(F.col(segment))).select(segments.columns))


#: Characters of texts that are searched at once.
_SPAN = 1 << 21


def _spans(batches: Iterator[pd.DataFrame], text: str) -> Iterator[list[str]]:
    """Texts of successive rows, about `_SPAN` characters of them at a time."""
    held, size = [], 0
    for batch in batches:
        for t in batch[text]:
            held.append(t)
            size += len(t)
            if size >= _SPAN:
                yield held
                held, size = [], 0
    if held:
        yield held


def close_quotes(asked: DataFrame, texts: DataFrame, segment: str, text: str, floor: float = 85.0) -> DataFrame:
    """(segment, score): the distinct segments that some text holds at a partial ratio of at least `floor`, and the best one.

    The segments are a stated set of answers and go to every task. A first pass finds, all at once, those that a text holds
    word for word; only the others are scored. Texts are streamed and stay where they are, unless they lie in few partitions:
    scoring costs far more than moving them. Null texts hold nothing.
    """
    if not floor > 200 / 3:
        raise ValueError("a floor must exceed 200 / 3")
    spark, needles = texts.sparkSession, [r[0] for r in asked.select(segment).where(F.length(segment) > 0).distinct().collect()]
    cores, rows = spark.sparkContext.defaultParallelism, texts.select(text).where(F.col(text).isNotNull())
    spread = lambda least: rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < least else rows
    form = f"`{segment}` string, score double"

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        search, held = ahocorasick.Automaton(), set()
        for place, needle in enumerate(needles):
            search.add_word(needle, place)
        search.make_automaton()
        for batch in batches:
            for t in batch[text] if needles else ():
                held.update(place for _, place in search.iter(t))
        yield pd.DataFrame({segment: [needles[i] for i in held], "score": 100.0}).astype({segment: object, "score": "float64"})

    exact = {r[0] for r in spread(cores).mapInPandas(whole, form).select(segment).distinct().collect()}
    rest = [n for n in needles if n not in exact]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, float] = {}
        search = Closeness(rest, floor)
        for span in _spans(batches, text):
            for at, score in search.best(span).items():
                best[at] = max(best.get(at, 0.0), score)
        yield pd.DataFrame({segment: [rest[i] for i in best], "score": [*best.values()]}).astype({segment: object, "score": "float64"})

    found = spark.createDataFrame([(n, 100.0) for n in needles if n in exact], form)
    if not rest:
        return found
    return found.unionByName(spread(4 * cores).mapInPandas(near, form).groupBy(segment).agg(F.max("score").alias("score")))


def citation_status(score: Column, threshold: float = 97.0) -> Column:
    return F.when(score >= threshold, "validated").when(score >= 85.0, "partial").otherwise("failed")


def reply_ok(question: Column, answer: Column, least: int = 10, most: int = 10_000) -> Column:
    q, a = F.coalesce(F.trim(question), F.lit("")), F.coalesce(F.trim(answer), F.lit(""))
    return (q != "") & (a != "") & F.length(a).between(least, most)


def reply_problems(question: Column, thinking: Column, answer: Column, content: Column, least: int = 10, most: int = 10_000) -> Column:
    """What is wrong with a generated pair, as an array: missing fields; else an answer too short or too long, or without
    a sentence of over 20 characters (parts after `. `) that the content holds without regard to case."""
    missing = [F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"missing {n}")) for n, c in (("question", question), ("thinking", thinking), ("answer", answer))]
    gaps = F.array_compact(F.array(*missing))
    low = F.lower(F.coalesce(content, F.lit("")))
    quoted = F.exists(F.split(answer, r"\. "), lambda x: (F.length(x) > 20) & low.contains(F.lower(x)))
    faults = F.array_compact(F.array(F.when(F.length(answer) < least, F.lit("too short")).when(F.length(answer) > most, F.lit("too long")), F.when(~F.coalesce(quoted, F.lit(False)), F.lit("not in content"))))
    return F.when(F.size(gaps) > 0, gaps).otherwise(faults)


def reversed_pairs(pairs: DataFrame, question: str, answer: str, confidence: str) -> DataFrame:
    """(…, reversed_question, reversed_answer, reversed_confidence): templates first, then a swap of names, then a generic form.

    Templates fit questions of one line; the name that is swapped is the last one of the whole question.
    """
    q, a = F.trim(F.regexp_replace(F.col(question), r"\?+$", "")), F.trim(F.col(answer))
    what = F.regexp_extract(q, r"(?i)^what (?:is|are) (?:the |an? )?(.+)$", 1)
    who = F.regexp_extract(q, r"(?i)^who (.+)$", 1)
    where = F.regexp_extract(q, r"(?i)^where (?:is|are) (.+)$", 1)
    names = F.regexp_extract_all(q, F.lit(r"(?:^|[^\p{L}\p{N}_])(\p{Lu}[\p{L}\p{N}_]+(?: \p{Lu}[\p{L}\p{N}_]+)*)"), F.lit(1))
    name = F.coalesce(F.get(names, F.size(names) - 1), F.lit(""))
    short = F.substring(a, 1, 80)
    new_q = F.when(what != "", F.concat(F.lit("What is described as: "), short, F.lit("?"))).when(who != "", F.concat(F.lit("What did "), short, F.lit(" do?"))).when(where != "", F.concat(F.lit("What is found in "), short, F.lit("?"))).when((name != "") & ~F.lower(q).startswith("how"), F.concat(F.lit("What is "), short, F.lit(" related to?"))).otherwise(F.concat(F.lit("Which question is answered by: "), short, F.lit("?")))
    new_a = F.when(what != "", what).when(who != "", who).when(where != "", where).when((name != "") & ~F.lower(q).startswith("how"), name).otherwise(F.col(question))
    return pairs.withColumns({"reversed_question": new_q, "reversed_answer": new_a, "reversed_confidence": F.round(F.col(confidence) * 0.9, 6)})


def allocated(types: DataFrame, total: int, share: str = "share", key: str = "type") -> DataFrame:
    """Whole counts by share: rounded down, the rest given one each in order of key."""
    w = Window.orderBy(key)
    base = types.withColumn("n", F.floor(F.col(share) * total).cast("long"))
    rest = base.agg((F.lit(total) - F.sum("n")).alias("rest"))
    return base.crossJoin(F.broadcast(rest)).withColumn("n", F.col("n") + (F.row_number().over(w) <= F.col("rest")).cast("long")).drop("rest")  # a row a type


def split(rows: DataFrame, key: str, ratios: dict[str, float], seed: int = 0, remainder_to: str | None = None) -> DataFrame:
    """rows with `split`, of exact sizes int(n r); the remainder goes to the largest split or a named one.

    The order is a seeded hash. A row's place comes from bucket counts and a rank within its bucket, so no task sees all.
    """
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    hashed = rows.withColumn("h__", digest).withColumn("b__", F.substring("h__", 1, 3))
    counts = rows.select(F.substring(digest, 1, 3).alias("b__")).groupBy("b__").count()  # 4,096 buckets at most
    before = counts.select("b__", F.coalesce(F.sum("count").over(Window.orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("n__"))
    placed = hashed.join(F.broadcast(before), "b__").withColumn("at__", F.col("before__") + F.row_number().over(Window.partitionBy("b__").orderBy("h__", key)))
    target = remainder_to or max(ratios, key=lambda k: ratios[k])
    sizes = {k: F.floor(F.col("n__") * F.lit(float(r))).cast("long") for k, r in ratios.items()}
    sizes[target] = F.col("n__") - sum((v for k, v in sizes.items() if k != target), F.lit(0))
    out, end = None, F.lit(0)
    for k, size in sizes.items():
        end = end + size
        out = F.when(F.col("at__") <= end, k) if out is None else out.when(F.col("at__") <= end, k)
    return placed.withColumn("split", out).select(*rows.columns, "split")


def weight(question_type: Column, confidence: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv))
    return F.coalesce(F.element_at(table, question_type), F.lit(0.5)) * confidence


def context_confidence(base: Column, evidence: Column, cited: Column, in_section: Column | None = None) -> Column:
    """How well an answer is grounded: base (0.7 if unknown) + 0.1 min(evidence / 3, 1), 0.15 up for a citation that was
    found and 0.2 down for one that was not (unchanged if unknown), 0.05 up in its own section; within 0 and 1."""
    known = F.coalesce(base, F.lit(0.7)) + F.coalesce(0.1 * F.least(evidence / 3, F.lit(1.0)), F.lit(0.0))
    found = F.when(cited, 0.15).when(~cited, -0.2).otherwise(0.0)
    section = F.when(in_section, 0.05).otherwise(0.0) if in_section is not None else F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), known + found + section))


def edges(pairs: DataFrame, entities: DataFrame, key: str, confidence: str, approve: float = 0.7) -> DataFrame:
    """An edge between the two most confident entities (key, name, confidence) of each pair."""
    w = Window.partitionBy(key).orderBy(F.desc("entity_confidence"), "name")
    best = entities.select(key, "name", F.col("confidence").alias("entity_confidence")).withColumn("r", F.row_number().over(w)).where("r <= 2")
    two = best.groupBy(key).agg(F.max(F.when(F.col("r") == 1, F.col("name"))).alias("src"), F.max(F.when(F.col("r") == 2, F.col("name"))).alias("dst"), F.product("entity_confidence").alias("entities")).where("dst IS NOT NULL")
    out = pairs.join(two, key).withColumn("edge_confidence", F.col(confidence) * F.col("entities"))
    return out.withColumn("review_status", F.when(F.col("edge_confidence") >= approve, "auto_approved").otherwise("pending")).drop("entities")


def chat(pairs: DataFrame, question: str, answer: str, context: str | None = None) -> DataFrame:
    """(messages): system (where there is a context), user and assistant turns."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = F.array(turn("user", F.col(question)), turn("assistant", F.col(answer)))
    if context:
        lead = F.when(F.col(context).isNotNull(), F.array(turn("system", F.concat(F.lit("Context: "), F.col(context)))))
        turns = F.concat(F.coalesce(lead, F.array().cast("array<struct<role string,content string>>")), turns)
    return pairs.withColumn("messages", turns)


def instruction(pairs: DataFrame, question: str, answer: str, context: str | None = None) -> DataFrame:
    return pairs.select(F.col(question).alias("instruction"), (F.coalesce(F.col(context), F.lit("")) if context else F.lit("")).alias("input"), F.col(answer).alias("output"))


def statistics(pairs: DataFrame, group: str, valid: str, score: str) -> DataFrame:
    return pairs.groupBy(group).agg(F.count("*").alias("total"), F.count_if(F.col(valid)).alias("valid"), F.avg(score).alias("average"), F.try_divide(F.count_if(F.col(valid)), F.count("*")).alias("rate"))


def summary(pairs: DataFrame, kind: str, valid: str, confidence: str, key: str, sample: list[str]) -> DataFrame:
    """(kind, total, share, valid, valid_share, average, sample): one row a type, with its first pair by key as a sample; shares
    are of all pairs and of the type's, null where there is none."""
    first = F.min_by(F.struct(*sample), F.col(key)).alias("sample")
    by = pairs.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("total"), F.count_if(F.col(valid)).alias("valid"), F.avg(confidence).alias("average"), first)
    return by.crossJoin(F.broadcast(by.agg(F.sum("total").alias("all")))).select("kind", "total", F.try_divide("total", "all").alias("share"), "valid", F.try_divide("valid", "total").alias("valid_share"), "average", "sample")  # one row


#: The columns of tabular exports.
CSV_COLUMNS = ["question", "answer", "thinking", "question_type", "confidence", "validation_score", "citation_found"]
PARQUET_COLUMNS = [*CSV_COLUMNS, "document_id", "created_at"]


def tabular(examples: DataFrame, columns: list[str] = PARQUET_COLUMNS) -> DataFrame:
    """Training examples (messages array<struct<role, content, thinking>>, metadata struct) as flat rows: the first message asks,
    the second answers; an answer without thinking has an empty one."""
    said = {"question": F.get("messages", 0)["content"], "answer": F.get("messages", 1)["content"], "thinking": F.coalesce(F.get("messages", 1)["thinking"], F.lit(""))}
    return examples.select(*((said[c] if c in said else F.col(f"metadata.{c}")).alias(c) for c in columns))


def confidence_band(confidence: Column) -> Column:
    """A missing confidence is low."""
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").otherwise("low")


def block_relations(blocks: DataFrame) -> DataFrame:
    """(source, target, type) between blocks (document_id, page, idx, type, level): order on a page, and section nesting.

    A block belongs to the nearest heading before it; a heading to the nearest before it of a smaller level.
    """
    ident = F.concat_ws(":", "document_id", "page", "idx")
    named = blocks.withColumn("id", ident)
    order = Window.partitionBy("document_id", "page").orderBy("idx")
    following = named.select(F.lag("id").over(order).alias("source"), F.col("id").alias("target"), F.lit("NEXT_IN_SEQUENCE").alias("type")).where("source IS NOT NULL")
    heading = F.col("level").isNotNull()
    above = Window.partitionBy("document_id").orderBy("page", "idx").rowsBetween(Window.unboundedPreceding, -1)
    contains = named.withColumn("source", F.last(F.when(heading, F.col("id")), ignorenulls=True).over(above)).where(~heading & F.col("source").isNotNull()).select("source", F.col("id").alias("target"), F.lit("CONTAINS").alias("type"))
    seen = {n: F.last(F.when(F.col("level") == n, F.struct("page", "idx", "id")), ignorenulls=True).over(above) for n in range(1, 6)}
    parents = named.where(heading).withColumns({f"p{n}": c for n, c in seen.items()})
    best = F.greatest(*(F.when(F.col("level") > n, F.col(f"p{n}")) for n in seen))
    nested = parents.withColumn("parent", best).where("parent IS NOT NULL").select(F.col("parent.id").alias("source"), F.col("id").alias("target"), F.lit("PARENT_CHILD").alias("type"))
    return following.unionByName(contains).unionByName(nested)


#: Kinds of captioned blocks by block type, and how texts name them.
CAPTIONED = {"image": "figure", "figure": "figure", "table": "table"}
_MENTION = r"(?<![\p{L}\p{N}])(fig(?=ure |\. | )|tab(?=le |\. | ))(?:ure|le|\.)? (\d+(?:\.\d+)?)(?![\p{L}\p{N}]|\.\d)"


def block_references(blocks: DataFrame) -> DataFrame:
    """(source, target, type, reference_type): text blocks that name a figure or table of their document by its number.

    Blocks (document_id, page, idx, type, text, caption). A caption that names its kind gives a figure or table its number;
    of equal ones the last counts. Numbers stand whole: Table 23 is not a mention of Table 2. Mentions meet captions by an
    equi-join on document, kind and number, so no text is searched for every caption.
    """
    ident = F.concat_ws(":", "document_id", "page", "idx")
    kind = F.element_at(F.create_map(*(F.lit(x) for p in CAPTIONED.items() for x in p)), F.col("type"))
    shown = blocks.where(F.col("type").isin(list(CAPTIONED))).select("document_id", kind.alias("kind"), first_number(F.col("caption")).alias("number"), F.struct("page", "idx", ident.alias("id")).alias("b"), "caption")
    targets = shown.where(F.lower("caption").contains(F.col("kind")) & F.col("number").isNotNull()).groupBy("document_id", "kind", "number").agg(F.max("b").alias("b"))
    low = F.lower(F.col("text"))
    named = F.arrays_zip(F.regexp_extract_all(low, F.lit(_MENTION), F.lit(1)).alias("k"), F.regexp_extract_all(low, F.lit(_MENTION), F.lit(2)).alias("number"))
    mentions = blocks.where(F.col("type") == "text").select("document_id", ident.alias("source"), F.explode(F.array_distinct(named)).alias("m"))
    mentions = mentions.select("document_id", "source", F.when(F.col("m.k") == "fig", "figure").otherwise("table").alias("kind"), F.col("m.number").alias("number")).distinct()
    return mentions.join(targets, ["document_id", "kind", "number"]).select("source", F.col("b.id").alias("target"), F.lit("REFERENCES").alias("type"), F.col("kind").alias("reference_type"))


#: Relations and their inverses; the first that a question holds counts.
INVERSIONS = [("causes", "is caused by"), ("is caused by", "causes"), ("leads to", "results from"), ("results from", "leads to"), ("contains", "is contained in"), ("is contained in", "contains"), ("precedes", "follows"), ("follows", "precedes")]


def inverted(question: Column) -> Column:
    """A relationship question the other way round, in lower case but for its first letter; null where it names no relation
    that has an inverse. The answer stays."""
    low = F.lower(question)
    turned = F.coalesce(*(F.when(low.contains(a), F.replace(low, F.lit(a), F.lit(b))) for a, b in INVERSIONS))
    return F.concat(F.upper(F.substring(turned, 1, 1)), F.substring(turned, 2, 2**31 - 1))


def rationale(title: Column, kind: Column, src: Column, dst: Column, section: Column | None = None, evidence: Column | None = None, score: Column | None = None, cited: Column | None = None) -> Column:
    """Why an edge holds, as sentences of at least 50 characters; what is missing, empty or zero is not mentioned."""
    none = F.lit(None).cast("string")
    parts = [
        F.concat(F.lit("Q&A extracted from document: "), F.coalesce(title, F.lit("Unknown"))),
        F.when(section != "", F.concat(F.lit("Section: "), section)) if section is not None else none,
        F.when(evidence > 0, F.concat(F.lit("Based on "), evidence.cast("string"), F.lit(" evidence blocks from source content"))) if evidence is not None else none,
        F.concat(F.lit("Establishes "), F.lower(kind), F.lit(" relationship between "), src, F.lit(" and "), dst),
        F.when(score != 0, F.concat(F.lit("Validated with confidence score of "), F.format_string("%.2f", score))) if score is not None else none,
        F.when(cited, F.lit("Source citations verified and found in document")) if cited is not None else none,
    ]
    text = F.concat_ws(". ", *parts)
    return F.when(F.length(text) < 50, F.concat(text, F.lit(". This Q&A pair provides contextual information derived from the document structure."))).otherwise(text)


def hierarchy(document: Column, **known: Column) -> Column:
    """A map of what is known of a document's place (document_title, section_title, parent_id, parent_title, path, level,
    heading_level); the document's id alone where nothing is."""
    given = [x for name, c in known.items() for x in (F.lit(name), c.cast("string"))]
    places = F.map_filter(F.create_map(*given), lambda _, v: v.isNotNull()) if given else F.create_map().cast("map<string,string>")
    return F.when(F.size(places) > 0, places).otherwise(F.create_map(F.lit("document_id"), document.cast("string")))


def review_export(edges: DataFrame, entities: DataFrame, key: str, status: str | None = "approved", band: str | None = None, document=None, limit: int | None = 1000) -> DataFrame:
    """(edge, from_entity, to_entity): question-answer edges (src, dst, type, confidence, review_status) with the entities
    (id, ...) at their ends, null where there is none; the first `limit` by key. For `files.write` as JSON lines.

    band is low, medium or high; a missing confidence is in none.
    """
    rows = edges.where("type = 'QA_DERIVED'")
    if status:
        rows = rows.where(F.col("review_status") == status)
    if band:
        rows = rows.where(F.col("confidence").isNotNull() & (confidence_band(F.col("confidence")) == band))
    if document is not None:
        rows = rows.where(F.col("source_document_id") == document)
    if limit is not None:
        rows = rows.orderBy(key).limit(limit)
    rows = rows.select(F.struct("*").alias("edge"))
    end = lambda name: entities.select(F.col("id").alias(f"{name}_id__"), F.struct("*").alias(name))
    out = rows.join(end("from_entity"), F.col("edge.src") == F.col("from_entity_id__"), "left").join(end("to_entity"), F.col("edge.dst") == F.col("to_entity_id__"), "left")
    return out.select("edge", "from_entity", "to_entity")


#: Kinds of objects that make up a document's text.
CORPUS_KINDS = ["text", "table", "code", "section"]


def corpus(objects: DataFrame) -> DataFrame:
    """Objects (document_id, type, text, ...) that citations are checked against: those kinds, where there is a text."""
    return objects.where(F.col("type").isin(CORPUS_KINDS) & F.col("text").isNotNull())
