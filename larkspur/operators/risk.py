"""Threat risk: scores of techniques, coverage of tactics, resilience, attack chains and critical paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Impact of a severity, likelihood of an exploitation complexity, weight of a detection difficulty.
IMPACT = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
LIKELIHOOD = {"very_low": 1.0, "low": 0.8, "medium": 0.6, "high": 0.4, "very_high": 0.2}
DETECTION = {"very_easy": 0.2, "easy": 0.4, "medium": 0.6, "hard": 0.8, "very_hard": 1.0}
COMPLEXITY_RANK = {"very_low": 1, "low": 2, "medium": 3, "high": 4, "very_high": 5}


def lookup(table: dict[str, float], key: Column, otherwise: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(otherwise))


def score(severity: Column, complexity: Column, detection: Column, countermeasures: Column) -> Column:
    """100 impact likelihood detection / mitigation, at most 100; mitigation is a fifth a countermeasure, 0.1 to 1."""
    mitigation = F.when(countermeasures > 0, F.least(F.lit(1.0), 0.2 * countermeasures)).otherwise(0.1)
    raw = 100 * lookup(IMPACT, severity, 0.5) * lookup(LIKELIHOOD, complexity, 0.6) * lookup(DETECTION, detection, 0.6) / mitigation
    return F.round(F.least(F.lit(100.0), raw), 2)


def tactic_coverage(techniques: DataFrame, tactic: str = "tactic", risk: str = "risk") -> DataFrame:
    return techniques.groupBy(tactic).agg(F.count("*").alias("techniques"), F.avg(risk).alias("avg_risk"), F.max(risk).alias("max_risk"), F.min(risk).alias("min_risk"))


def resilience(techniques: DataFrame) -> DataFrame:
    """One row: share of techniques with countermeasures, countermeasures on average, and how far four of them on each
    technique, weighted by severity, are reached; percentages and averages to two digits, 0 without techniques."""
    n = F.coalesce("countermeasures", F.lit(0))
    held = lookup(IMPACT, F.col("severity"), 0.5) * F.least(F.lit(1.0), 0.25 * n)
    share = lambda x: F.round(F.coalesce(F.try_divide(x, F.count("*")), F.lit(0.0)), 2)
    return techniques.agg(
        share(100.0 * F.count_if(n > 0)).alias("coverage_percentage"),
        share(F.sum(n)).alias("average_countermeasures_per_technique"),
        share(100 * F.sum(held)).alias("weighted_resilience_score"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_countermeasures"),
        F.count_if(n > 0).alias("techniques_with_countermeasures"),
        F.count("*").alias("total_techniques"),
    )


def severity_distribution(techniques: DataFrame) -> DataFrame:
    return techniques.groupBy("severity").agg(F.count("*").alias("techniques"), F.count_if(F.col("countermeasures") > 0).alias("mitigated"))


def attack_chains(steps: DataFrame, chain: str) -> DataFrame:
    """A row a chain: summed and average risk, product of likelihoods, and the chance that any step is detected."""
    caught = 1 - lookup(DETECTION, F.col("detection"), 0.6)
    return steps.groupBy(chain).agg(F.count("*").alias("steps"), F.sum("risk").alias("total_risk"), F.avg("risk").alias("avg_risk"), F.product(lookup(LIKELIHOOD, F.col("complexity"), 0.6)).alias("likelihood"), (1 - F.product(1 - caught)).alias("detection"))


def critical_path(techniques: DataFrame, path: list[str], key: str) -> DataFrame:
    """The riskiest technique of each tactic on a path; nothing unless every tactic has one."""
    best = techniques.where(F.col("tactic").isin(path)).groupBy("tactic").agg(F.max_by(key, F.struct("risk", -F.col(key))).alias(key), F.max("risk").alias("risk"))
    full = best.agg((F.count("*") == len(set(path))).alias("full"))
    return best.crossJoin(F.broadcast(full)).where("full").drop("full")  # one row


def for_actor(techniques: DataFrame, most_complex: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """What an actor can do: complexity up to theirs, tactics they use, none that they avoid."""
    rows = techniques.where(lookup(COMPLEXITY_RANK, F.col("complexity"), 9) <= COMPLEXITY_RANK[most_complex])
    if include:
        rows = rows.where(F.col("tactic").isin(include))
    return rows.where(~F.col("tactic").isin(exclude)) if exclude else rows


def attributed(observed: DataFrame, profiles: DataFrame, group: str) -> DataFrame:
    """(group, actor, score): the actor whose weighted techniques (actor, technique, weight) explain most of what was seen."""
    scores = observed.join(profiles, "technique").groupBy(group, "actor").agg(F.sum("weight").alias("score"))
    return scores.groupBy(group).agg(F.min_by("actor", F.struct(-F.col("score"), "actor")).alias("actor"), F.max("score").alias("score"))


#: Columns of an exported matrix and where each comes from.
MATRIX = {"ID": "id", "Name": "name", "Tactic": "tactic", "Severity": "severity", "Risk Score": "risk", "Detection Difficulty": "detection", "Exploitation Complexity": "complexity", "Countermeasures Count": "countermeasures"}


def matrix_rows(techniques: DataFrame) -> DataFrame:
    """The eight columns of a matrix export, for `files.write` as JSON or CSV; a missing score reads N/A."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")) if c == "risk" else F.col(c)
    return techniques.select(*(value(c).alias(name) for name, c in MATRIX.items()))


def found(techniques: DataFrame, text: str, field: str = "all") -> DataFrame:
    """Techniques that hold a text, whatever its case, in a field: id, name, description, or all of these and the elements
    of the arrays `examples` and `countermeasures`. Nulls hold nothing."""
    if field not in ("all", "id", "name", "description"):
        raise ValueError(f"no field to search: {field}")
    low = text.lower()
    held = lambda c: F.coalesce(F.lower(c).contains(F.lit(low)), F.lit(False))
    if field != "all":
        return techniques.where(held(F.col(field)))
    listed = (F.coalesce(F.exists(c, held), F.lit(False)) for c in ("examples", "countermeasures"))
    where = held(F.col("id")) | held(F.col("name")) | held(F.col("description"))
    for c in listed:
        where = where | c
    return techniques.where(where)


def threat_metrics(techniques: DataFrame) -> DataFrame:
    """techniques with risk_score, and impact, likelihood, detection and mitigation in percent: the rows of an enriched
    matrix and of its heatmap. Unknown or missing levels read medium, missing countermeasures none."""
    n = F.coalesce("countermeasures", F.lit(0))
    return techniques.withColumns(
        {
            "risk_score": score(F.col("severity"), F.col("complexity"), F.col("detection"), n),
            "impact_score": 100 * lookup(IMPACT, F.col("severity"), 0.5),
            "likelihood_score": 100 * lookup(LIKELIHOOD, F.col("complexity"), 0.6),
            "detection_score": 100 * lookup(DETECTION, F.col("detection"), 0.6),
            "mitigation_effectiveness": F.when(n > 0, F.least(F.lit(100.0), 20.0 * n)).otherwise(10.0),
        }
    )


def detected_in(analyses: DataFrame, key: str, techniques: str, score: str) -> DataFrame:
    """(src, dst, confidence): an edge from each analysis to each technique that it names; a missing score is 0, and an
    analysis without techniques has no edge."""
    return analyses.select(F.col(key).alias("src"), F.explode(techniques).alias("dst"), F.coalesce(F.col(score), F.lit(0.0)).cast("double").alias("confidence"))
