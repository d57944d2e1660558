"""Entities: regex extraction of names and relations, matching by name and vector, and merging of attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import matrix
from larkspur.functions.text import name_variants

#: Technologies that are known by name: a list to be replaced by one's own.
TECHNOLOGIES = ("Python", "JavaScript", "TypeScript", "Java", "Ruby", "Go", "MongoDB", "MySQL", "PostgreSQL", "AWS", "Azure", "Docker", "Kubernetes")
#: Pattern, type and confidence of entities in text.
ENTITY_PATTERNS = [
    (r"([A-Z][a-z]+ [A-Z][a-z]+)", "PERSON", 0.7),
    (r"((?:[A-Z][a-zA-Z]+ (?:Inc\.|Corp\.|LLC|Company|Association|University|Institute))|(?:[A-Z][A-Za-z]+ [A-Z][A-Za-z]+ (?:Inc\.|Corp\.|LLC|Company|Association)))", "ORGANIZATION", 0.75),
    (r"(?i)([a-z][a-z]+ (?:algorithm|framework|method|technique|system|process|model|architecture))", "CONCEPT", 0.65),
    (rf"\b({'|'.join(TECHNOLOGIES)})\b", "TECHNOLOGY", 0.85),
]
#: A run of words and white space, taken from its first word on: no later start can match where that one does not, so each
#: run is tried once.
_RUN = r"(?<![\w\s])\s*+(\w[\w\s]+)"
_WORDS = r"(\w[\w\s]+)"
#: Pattern, type, confidence, and the groups of source and target (0: the row's own name) of relations.
RELATION_PATTERNS = [
    (_RUN + r"\s(?:refers to|references|mentions|cites)\s" + _WORDS, "REFERENCES", 0.9, 1, 2),
    (r"as\smentioned\sin\s['\"]?" + _WORDS + r"['\"]?", "REFERENCES", 0.85, 0, 1),
    (r"according\s+to\s+(?:the\s+)?(['\"]?[\w\s]+[\w]['\"]?)", "REFERENCES", 0.85, 0, 1),
    (r"[\[(]((?<=\[)[^\]]+(?=\])|(?<=\()[^)]+(?=\)))[\])]", "REFERENCES", 0.9, 0, 1),
    (_RUN + r"\s(?:requires|needs|depends on)\s" + _WORDS, "PREREQUISITE", 0.85, 2, 1),
    (r"before\s(?:using|understanding)\s" + _WORDS + r",\s(?:you|one)\s(?:should|must|needs to)\s(?:know|understand)\s" + _WORDS, "PREREQUISITE", 0.85, 2, 1),
    (_RUN + r"\sis\s(?:essential|necessary|required)\sfor\s" + _WORDS, "PREREQUISITE", 0.85, 2, 1),
    (_RUN + r"\s(?:causes|results in|leads to|triggers)\s" + _WORDS, "CAUSAL", 0.8, 1, 2),
    (r"(?:due to|because of|as a result of)\s" + _WORDS + r",\s" + _WORDS, "CAUSAL", 0.8, 1, 2),
    (r"if\s" + _WORDS + r",\sthen\s" + _WORDS, "CAUSAL", 0.8, 1, 2),
]


def _found(rows: DataFrame, key: str, text: str, patterns: list[tuple[str, str, float]], name: str) -> DataFrame:
    hits = [F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(1)), _as_hit(name, t, c)) for p, t, c in patterns]
    return rows.select(key, F.explode(F.flatten(F.array(*hits))).alias("m")).select(key, "m.*")


def _as_hit(name: str, kind: str, confidence: float):
    return lambda x: F.struct(F.trim(x).alias(name), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))


def _as_relation(kind: str, confidence: float):
    return lambda s, t: F.struct(s.alias("source"), t.alias("target"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))


def entities(rows: DataFrame, key: str, text: str, patterns: list[tuple[str, str, float]] = ENTITY_PATTERNS) -> DataFrame:
    """(key, name, type, confidence): each name once a row, as its most confident type."""
    found = _found(rows, key, text, patterns, "name")
    return found.groupBy(key, "name").agg(F.min_by("type", F.struct(-F.col("confidence"), "type")).alias("type"), F.max("confidence").alias("confidence"))


def united(found: dict[str, DataFrame], known: DataFrame, key: str, default: float = 0.8) -> DataFrame:
    """(key column, key, name, type, confidence): what several extractors found in each row, each a table (key column, name, type,
    confidence), once.

    A name that is known (key, name, type, confidence) without regard to case takes the known row's key, name and type at the
    higher confidence (`default` where the known row has none); of several known rows of a name the smallest key counts.
    Others are once a name and type, at their highest confidence.
    """
    rows = None
    for name, part in found.items():
        one = part.select(F.col(key).alias("row__"), "name", "type", F.col("confidence").cast("double").alias("confidence"))
        rows = one if rows is None else rows.unionByName(one)
    first = known.groupBy(F.lower("name").alias("low__")).agg(F.min_by(F.struct(F.col("key").alias("k"), F.col("name").alias("n"), F.col("type").alias("t"), F.coalesce(F.col("confidence").cast("double"), F.lit(default)).alias("c")), "key").alias("known"))
    met = rows.withColumn("low__", F.lower("name")).join(first, "low__", "left")
    out = met.select(F.col("row__").alias(key), F.col("known.k").alias("key"), F.coalesce("known.n", "name").alias("name"), F.coalesce("known.t", "type").alias("type"), F.greatest("confidence", "known.c").alias("confidence"))
    return out.groupBy(key, "key", "name", "type").agg(F.max("confidence").alias("confidence"))


def relations(rows: DataFrame, key: str, text: str, floor: float = 0.7, most: int = 10, patterns: list[tuple[str, str, float, int, int]] = RELATION_PATTERNS, name: str | None = None) -> DataFrame:
    """(key, source, target, type, confidence): the first `most` relations of each text in the order of patterns and places.

    Where a pattern names one side only, the other is the row's own name (`name`); without it such relations are left out.
    """
    own, value = F.col(name).cast("string") if name else F.lit(None).cast("string"), F.coalesce(F.col(text), F.lit(""))
    hits = []
    for p, kind, confidence, source, target in patterns:
        if confidence < floor:
            continue
        side = lambda g, p=p: F.transform(F.regexp_extract_all(value, F.lit(f"(?iU){p}"), F.lit(g)), lambda x: F.trim(x))
        there = side(target)
        sources = side(source) if source else F.transform(there, lambda x: own)
        hits.append(F.zip_with(sources, there, _as_relation(kind, confidence)))
    found = F.filter(F.flatten(F.array(*hits)), lambda h: h["source"].isNotNull())
    return rows.select(key, F.explode(F.slice(found, 1, most)).alias("m")).select(key, "m.*")


def exact_matches(new: DataFrame, known: DataFrame, new_key: str, known_key: str, name: str = "name") -> DataFrame:
    """(new_key, known_key) where a variant of the new name equals a known name without regard to case."""
    a = new.select(F.col(new_key), F.explode(name_variants(F.col(name))).alias("variant"))
    return a.join(known.select(F.col(known_key), F.lower(name).alias("variant")), "variant").select(new_key, known_key).distinct()


def similar_matches(new: DataFrame, known: DataFrame, new_key: str, known_key: str, column: str, floor: float = 0.85, most: int = 5, block: str | None = None, strict: bool = False) -> DataFrame:
    """(new_key, known_key, similarity): up to `most` known vectors at a cosine of at least `floor`, by products of tiles.

    `block` compares only rows of an equal column (a type, say); without it every new row meets every known one.
    """
    return matrix.best_matches(new, known, new_key, known_key, column, floor, most, F.col(block) if block else None, strict=strict)


def match_confidence(name_exact: Column, name_close: Column, same_type: Column, attributes: Column, embedding: Column) -> Column:
    """A weighted mean of what is known: an exact name weighs 3, a close one 2, type 1.5, attributes 1, vectors 2."""
    parts = [(F.when(name_exact, 1.0), F.when(name_exact, 3.0)), (F.when(~name_exact, name_close), F.when(~name_exact, 2.0)), (same_type.cast("double"), F.lit(1.5)), (attributes, F.lit(1.0)), (embedding, F.lit(2.0))]
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0))
    weights = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts), F.lit(0.0))
    return F.try_divide(total, weights)


def merged_attributes(old: Column, new: Column, strategy: str) -> Column:
    """prefer_existing, prefer_new (and union): the other map fills gaps; intersection: keys with equal values."""
    if strategy == "intersection":
        return F.map_filter(old, lambda k, v: F.coalesce(F.element_at(new, k) == v, F.lit(False)))
    first, second = (new, old) if strategy == "prefer_existing" else (old, new)
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k))), F.map_entries(second)))


def resolved(new: DataFrame, known: DataFrame, new_key: str, known_key: str, name: str, column: str, floor: float = 0.8, block: str | None = None) -> DataFrame:
    """(new_key, known_key, confidence, action): an exact match first, else the most similar one (of equal `block`, if given),
    else an insert."""
    exact = exact_matches(new, known, new_key, known_key, name).groupBy(new_key).agg(F.min(known_key).alias(known_key)).withColumn("confidence", F.lit(1.0))
    rest = new.join(exact, new_key, "left_anti")
    near = similar_matches(rest, known, new_key, known_key, column, floor, 1, block).withColumnRenamed("similarity", "confidence")
    found = exact.select(new_key, known_key, "confidence").unionByName(near.select(new_key, known_key, "confidence"))
    return new.select(new_key).join(found, new_key, "left").withColumn("action", F.when(F.col(known_key).isNull(), "insert").otherwise("merge"))


def checked_edges(rows: DataFrame, least_rationale: int = 50) -> DataFrame:
    """rows with `edge_ok`: a rationale long enough and a confidence within 0 and 1."""
    return rows.withColumn("edge_ok", F.coalesce((F.length("rationale") >= least_rationale) & F.col("confidence").between(0, 1), F.lit(False)))
