"""Mixing sources to target weights, in DataFrame operations only: iterative proportional fitting, then sampling.

Each document falls into a cell (source, language, topic); categories that a target does not name fall into `other`, so
the number of cells is bounded by the targets, not by the data. Token weights of the cells are raked: one marginal after
the other is scaled to its target until every share is within `TOLERANCE` of its goal, or until rounds no longer bring it
nearer (targets that no weights can meet); `residual` tells how far it is. The scale of a cell is its fitted over its observed weight;
divided by the largest scale it is the probability with which each of its documents stays, so expected token shares match
the fitted margins. A document stays if a hash of its key and the seed falls below the probability.

Defined cases: a null category is `other`; a null text has no tokens; targets of categories without tokens are spread over
the rest of their marginal; a goal of 0, given or by leaving `other` out, removes all documents of that category; without
any tokens every document stays; repeated rows of one id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import hash01, written

OTHER = "other"
#: The largest difference between a share and its goal that counts as met; rounds between two looks at it.
TOLERANCE, _LOOK = 1e-12, 5


def category(column: str, target: dict[str, float]) -> Column:
    c = F.col(column).cast("string")
    return F.when(c.isin([k for k in target if k != OTHER]), c).otherwise(F.lit(OTHER))


def tokens(text_col: str) -> Column:
    """Runs of other characters than ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _goal(dim: str, target: dict[str, float]) -> Column:
    named = F.lit(0.0)
    for k, v in target.items():
        named = F.when(F.col(dim) == k, F.lit(float(v))).otherwise(named)
    return named


def raked(cells: DataFrame, targets: dict[str, dict[str, float]], tolerance: float = TOLERANCE) -> DataFrame:
    """cells (one column a dimension, `tokens`) with `scale`, `probability` and `residual`.

    There are at most prod(len(target) + 1) cells, so they are fitted in one partition, which no round has to shuffle.
    """
    dims = list(targets)
    fit = cells.where("tokens > 0").coalesce(1).withColumn("w", F.col("tokens").cast("double"))
    everything = Window.partitionBy(F.lit(0))
    for d in dims:
        w = Window.partitionBy(d)
        fit = fit.withColumn(f"goal_{d}", _goal(d, targets[d]))
        fit = fit.withColumn("share__", F.col(f"goal_{d}") / F.count("*").over(w)).withColumn(f"goal_{d}", F.when(F.sum("share__").over(everything) > 0, F.col(f"goal_{d}") / F.sum("share__").over(everything)).otherwise(F.lit(1.0))).drop("share__")
    fit, before, missed = written(fit, "cells"), None, 1.0
    while missed > tolerance and (before is None or missed < 0.999 * before):
        for d in dims * _LOOK:
            total = F.sum("w").over(Window.partitionBy(d).orderBy(*dims).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            fit = fit.coalesce(1).withColumn("w", F.when(total > 0, F.col("w") * F.col(f"goal_{d}") / total).otherwise(F.lit(0.0)))
        fit = written(fit, "cells")
        off = [F.abs(F.sum("w").over(Window.partitionBy(d)) / F.sum("w").over(everything) - F.col(f"goal_{d}")) for d in dims]
        before, missed = missed if before is not None else 2.0, fit.coalesce(1).select(F.greatest(*off, F.lit(0.0)).alias("off")).agg(F.max("off")).first()[0] or 0.0
    fit = fit.coalesce(1).withColumn("scale", F.col("w") / F.col("tokens")).withColumn("residual", F.lit(float(missed)))
    top = F.max("scale").over(everything)
    return fit.withColumn("probability", F.when(top > 0, F.col("scale") / top).otherwise(F.lit(1.0))).select(*dims, "tokens", "scale", "probability", "residual")


def mixture(docs: DataFrame, targets: dict[str, dict[str, float]], id_col: str = "doc_id", text_col: str = "text", seed: int = 0, tokens_col: str | None = None) -> DataFrame:
    """docs' columns with the cell (`cell_<dimension>`), `n_tokens__`, `probability__` and `stays__`.

    The dimensions are columns of docs; topic labels are joined by the caller, who may count tokens before that join and
    name the count's column. Columns of docs by a name of the result give way to it.
    """
    cats = {d: f"cell_{d}" for d in targets}
    kept = [c for c in docs.columns if c not in (*cats.values(), "n_tokens__", "probability__", "stays__")]
    rows = docs.withColumns({c: category(d, targets[d]) for d, c in cats.items()} | {"n_tokens__": F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else tokens(text_col)})
    counted = written(rows.groupBy(*cats.values()).agg(F.sum("n_tokens__").alias("tokens")), "tokens")
    fitted = raked(counted, {cats[d]: t for d, t in targets.items()})
    fitted = F.broadcast(fitted.select(*cats.values(), F.col("probability").alias("probability__")))  # as many rows as cells, a bound of the targets
    p = F.coalesce("probability__", F.lit(1.0))
    return rows.join(fitted, list(cats.values()), "left").withColumn("probability__", p).withColumn("stays__", hash01(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed=seed) < p).select(*kept, *cats.values(), "n_tokens__", "probability__", "stays__")
