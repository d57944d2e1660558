"""Versions of a message and the column rewrites between them, upward and downward."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSIONS = ["1.0", "1.1", "2.0", "2.1"]


def _add(column: str, value: str | None) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df if column in df.columns else df.withColumn(column, F.lit(value).cast("string"))


def _rename(old: str, new: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumnRenamed(old, new)


def _drop(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.drop(*columns)


#: 1.1 adds a priority, 2.0 wraps content and calls its kind `type`, 2.1 adds a correlation id.
UP = {
    "1.1": [_add("priority", "normal")],
    "2.0": [_rename("kind", "type"), lambda df: df.withColumn("content", F.struct(F.col("content").alias("text"), F.col("priority").alias("priority"))).drop("priority")],
    "2.1": [_add("correlation_id", None)],
}
DOWN = {
    "2.1": [_drop("correlation_id")],
    "2.0": [lambda df: df.withColumns({"priority": F.col("content.priority"), "content": F.col("content.text")}), _rename("type", "kind")],
    "1.1": [_drop("priority")],
}


def path(old: str, new: str) -> list[tuple[str, str]]:
    """Steps (direction, version) from one version to another."""
    a, b = VERSIONS.index(old), VERSIONS.index(new)
    return [("up", v) for v in VERSIONS[a + 1 : b + 1]] if a <= b else [("down", v) for v in reversed(VERSIONS[b + 1 : a + 1])]


def migrated(messages: DataFrame, old: str, new: str) -> DataFrame:
    for direction, version in path(old, new):
        for step in (UP if direction == "up" else DOWN)[version]:
            messages = step(messages)
    return messages.withColumn("version", F.lit(new))


def column_kinds(df: DataFrame) -> dict[str, str]:
    """How a table shows each column: number, boolean, date or string."""
    kind = lambda t: "boolean" if t == "boolean" else "date" if t in ("date", "timestamp", "timestamp_ntz") else "number" if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else "string"
    return {c: kind(t) for c, t in df.dtypes}
