"""A document store as pure functions on DataFrames: what comes back is the new table, which the caller writes.

Parquet has no row-level updates, so changes are joins against the small set of changed rows; keep versions (see
operators.temporal) where history matters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def equal(**filters) -> Column:
    """A conjunction of equalities; no filter is true."""
    return reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) if v is not None else F.col(c).isNull() for c, v in filters.items()), F.lit(True))


def page(rows: DataFrame, where: Column | str | None = None, order: list[Column | str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = rows if where is None else rows.where(where)
    return (rows.orderBy(*order) if order else rows).offset(offset).limit(limit)


def point(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value)


def created(rows: DataFrame, key: str = "key", time: str = "created_at") -> DataFrame:
    """New rows with a key and a time where they have none."""
    have = set(rows.columns)
    return rows.withColumns({key: F.coalesce(F.col(key), F.uuid()) if key in have else F.uuid(), time: F.coalesce(F.col(time), F.current_timestamp()) if time in have else F.current_timestamp()})


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with non-null values of changes laid over theirs."""
    cols = [c for c in changes.columns if c != key]
    other = changes.select(key, *(F.col(c).alias(f"new__{c}") for c in cols))
    out = rows.join(other, key, "left").withColumns({c: F.coalesce(f"new__{c}", c) if c in rows.columns else F.col(f"new__{c}") for c in cols})
    return out.select(*rows.columns, *(c for c in cols if c not in rows.columns))


def deleted(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on).distinct(), on, "left_anti")


def incremented(rows: DataFrame, changes: DataFrame, key: str, counter: str, by: str | None = None) -> DataFrame:
    """rows with `counter` raised by the changes of their key: one each, or the sum of column `by`; a missing count starts at 0.
    Changes are added up before the join, so one key with most of them is no one task's work."""
    added = changes.groupBy(F.col(key).alias("key__")).agg((F.sum(by) if by else F.count("*")).alias("added__"))
    new = F.coalesce(F.col(counter), F.lit(0)) + F.coalesce(F.col("added__"), F.lit(0))
    return rows.join(added, rows[key] == added["key__"], "left").withColumn(counter, new).select(rows.columns)


def upserted(rows: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key of both tables; new rows win ties."""
    both = rows.withColumn("new__", F.lit(0)).unionByName(new.withColumn("new__", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("new__"))
    return both.withColumn("r__", F.row_number().over(w)).where("r__ = 1").drop("r__", "new__")


def keep_highest(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """One row a key: of the highest value, ties to the smaller `tie`; an aggregate, so it combines before the shuffle."""
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(value), -F.col(tie)))
    return rows.groupBy(*keys).agg(best.alias("best")).select("best.*")


def would_change(rows: DataFrame, where: Column, key: str, limit: int | None = None) -> DataFrame:
    """The dry run of `bulk_updated`: the rows that it would change, as they are."""
    which = rows.where(where)
    return which if limit is None else which.orderBy(key).limit(limit)


def bulk_updated(rows: DataFrame, where: Column, values: dict[str, Column], key: str, limit: int | None = None) -> DataFrame:
    """Change rows that `where` names, the first `limit` by key at most."""
    which = would_change(rows, where, key, limit).select(key)
    out = rows.join(which.withColumn("hit__", F.lit(True)), key, "left")
    return out.withColumns({c: F.when(F.col("hit__"), v).otherwise(F.col(c)) for c, v in values.items()}).select(rows.columns)


def cascade(root: DataFrame, root_key: str, keys: DataFrame, dependants: list[tuple[DataFrame, str]]) -> tuple[DataFrame, list[DataFrame]]:
    """root without keys, and each dependant table without rows that point at them."""
    gone = keys.select(F.col(root_key)).distinct()
    return root.join(gone, root_key, "left_anti"), [d.join(gone.withColumnRenamed(root_key, c), c, "left_anti") for d, c in dependants]


def sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """A query with named parameters over tables given by name."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args)
