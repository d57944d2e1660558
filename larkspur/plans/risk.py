"""Threat analytics over orders read as techniques: priority is severity, status complexity, the day's rest a tactic."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import risk as r
from larkspur.plans.registry import query, table

_T = """t AS (SELECT o_orderkey AS id, o_custkey AS chain, CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
CASE o_orderkey % 6 WHEN 0 THEN 'very_low' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 4 THEN 'very_high' ELSE 'unknown' END AS complexity,
CASE o_orderkey // 6 % 6 WHEN 0 THEN 'very_easy' WHEN 1 THEN 'easy' WHEN 2 THEN 'medium' WHEN 3 THEN 'hard' WHEN 4 THEN 'very_hard' ELSE 'unknown' END AS detection, o_orderkey % 4 AS cm, 'T' || (o_orderkey % 7) AS tactic FROM orders),
k AS (SELECT *, CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END::DOUBLE AS im, CASE complexity WHEN 'very_low' THEN 1.0 WHEN 'low' THEN 0.8 WHEN 'high' THEN 0.4 WHEN 'very_high' THEN 0.2 ELSE 0.6 END::DOUBLE AS lk, CASE detection WHEN 'very_easy' THEN 0.2 WHEN 'easy' THEN 0.4 WHEN 'hard' THEN 0.8 WHEN 'very_hard' THEN 1.0 ELSE 0.6 END::DOUBLE AS dt FROM t),
x AS (SELECT *, round(least(100.0, 100 * im * lk * dt / CASE WHEN cm > 0 THEN least(1.0, 0.2::DOUBLE * cm) ELSE 0.1::DOUBLE END), 2)::DOUBLE AS risk FROM k)"""


def _level(n, levels):
    """The nth of the levels, `unknown` beyond them."""
    return F.coalesce(F.get(F.array(*map(F.lit, levels)), n.cast("int")), F.lit("unknown"))


def _techniques(spark, sf):
    o = table(spark, sf, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    rows = o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("chain"),
        F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "medium").otherwise("low").alias("severity"),
        _level(F.col("o_orderkey") % 6, r.LIKELIHOOD).alias("complexity"),
        _level(F.floor(F.col("o_orderkey") / 6) % 6, r.DETECTION).alias("detection"),
        (F.col("o_orderkey") % 4).alias("countermeasures"),
        F.concat(F.lit("T"), (F.col("o_orderkey") % 7).cast("string")).alias("tactic"),
    )
    return rows.withColumn("risk", r.score(F.col("severity"), F.col("complexity"), F.col("detection"), F.col("countermeasures")))


@query(f"WITH {_T} SELECT id, risk FROM x")
def risk_score(spark, sf):
    return _techniques(spark, sf).select("id", "risk")


@query(f"WITH {_T} SELECT tactic, count(*) AS techniques, round(avg(risk), 4) AS avg_risk, max(risk) AS max_risk, min(risk) AS min_risk FROM x GROUP BY 1")
def tactic_coverage(spark, sf):
    return r.tactic_coverage(_techniques(spark, sf)).withColumn("avg_risk", F.round("avg_risk", 4))


@query(f"""WITH {_T} SELECT round(100.0 * count(*) FILTER (WHERE cm > 0) / count(*), 2)::DOUBLE AS coverage_percentage, round(sum(cm) / count(*), 2)::DOUBLE AS average_countermeasures_per_technique,
round(100 * sum(im * least(1.0::DOUBLE, 0.25::DOUBLE * cm)) / count(*), 2)::DOUBLE AS weighted_resilience_score, sum(cm)::BIGINT AS total_countermeasures, count(*) FILTER (WHERE cm > 0) AS techniques_with_countermeasures, count(*) AS total_techniques FROM x""")
def resilience(spark, sf):
    return r.resilience(_techniques(spark, sf))


@query(f"WITH {_T} SELECT severity, count(*) AS techniques, count(*) FILTER (WHERE cm > 0) AS mitigated FROM x GROUP BY 1")
def severity_distribution(spark, sf):
    return r.severity_distribution(_techniques(spark, sf))


@query(f"WITH {_T} SELECT chain, count(*) AS steps, round(sum(risk), 4) AS total_risk, round(product(lk), 6) AS likelihood, round(1 - product(dt), 6) AS detection FROM x GROUP BY 1")
def attack_chain(spark, sf):
    out = r.attack_chains(_techniques(spark, sf), "chain")
    return out.select("chain", "steps", F.round("total_risk", 4).alias("total_risk"), F.round("likelihood", 6).alias("likelihood"), F.round("detection", 6).alias("detection"))


@query(f"WITH {_T} SELECT tactic, id, risk FROM (SELECT *, row_number() OVER (PARTITION BY tactic ORDER BY risk DESC, id) AS r FROM x WHERE tactic IN ('T1', 'T3', 'T5')) WHERE r = 1")
def critical_path(spark, sf):
    return r.critical_path(_techniques(spark, sf), ["T1", "T3", "T5"], "id")


@query(f"WITH {_T} SELECT id, risk FROM x ORDER BY risk DESC, id LIMIT 10")
def top_threats(spark, sf):
    return _techniques(spark, sf).orderBy(F.desc("risk"), "id").limit(10).select("id", "risk")


@query(f"WITH {_T} SELECT id FROM x WHERE complexity IN ('very_low', 'low', 'medium') AND tactic IN ('T1', 'T2') AND severity = 'critical'")
def actor_techniques(spark, sf):
    return r.for_actor(_techniques(spark, sf), "medium", ["T1", "T2"]).where("severity = 'critical'").select("id")


@query(f"WITH {_T}, w(actor, tactic, weight) AS (VALUES ('A', 'T1', 2.0), ('A', 'T2', 1.0), ('B', 'T3', 2.5), ('B', 'T1', 0.5)), s AS (SELECT chain, actor, sum(weight)::DOUBLE AS score FROM x JOIN w USING (tactic) GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY score DESC, actor) AS r FROM s) SELECT chain, actor, score FROM z WHERE r = 1")
def actor_attribution(spark, sf):
    profiles = spark.createDataFrame([("A", "T1", 2.0), ("A", "T2", 1.0), ("B", "T3", 2.5), ("B", "T1", 0.5)], "actor string, technique string, weight double")
    return r.attributed(_techniques(spark, sf).withColumnRenamed("tactic", "technique"), F.broadcast(profiles), "chain")
