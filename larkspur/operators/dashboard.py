"""Dashboards as rows with an array of widgets, and their placement on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(dashboards: DataFrame, owner: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Of an owner, with any of some tags."""
    if owner is not None:
        dashboards = dashboards.where(F.col("owner") == owner)
    return dashboards.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else dashboards


def cloned(dashboards: DataFrame, key: str, value, new_value, name: str) -> DataFrame:
    return dashboards.where(F.col(key) == value).withColumns({key: F.lit(new_value), "name": F.lit(name)})


def with_widget(dashboards: DataFrame, which: Column, widget: Column) -> DataFrame:
    return dashboards.withColumn("widgets", F.when(which, F.array_append(F.coalesce("widgets", F.array()), widget)).otherwise(F.col("widgets")))


def without_widget(dashboards: DataFrame, widget_id: str) -> DataFrame:
    return dashboards.withColumn("widgets", F.filter("widgets", lambda w: w["id"] != widget_id))


def moved_widget(dashboards: DataFrame, widget_id: str, x: int, y: int) -> DataFrame:
    move = lambda w: F.when(w["id"] == widget_id, w.withField("x", F.lit(x)).withField("y", F.lit(y))).otherwise(w)
    return dashboards.withColumn("widgets", F.transform("widgets", move))


def collisions(widgets: DataFrame, dashboard: str) -> DataFrame:
    """(dashboard, one, two) of widgets (id, x, y, w, h) whose rectangles overlap."""
    a, b = (widgets.select(dashboard, *(F.col(c).alias(f"{s}_{c}") for c in ("id", "x", "y", "w", "h"))) for s in ("a", "b"))
    apart = "a_x + a_w <= b_x OR b_x + b_w <= a_x OR a_y + a_h <= b_y OR b_y + b_h <= a_y"
    return a.join(b, dashboard).where("a_id < b_id").where(f"NOT ({apart})").select(dashboard, F.col("a_id").alias("one"), F.col("b_id").alias("two"))


def first_free(widgets: DataFrame, dashboard: str, width: int, height: int, columns: int = 12, rows: int = 100) -> DataFrame:
    """(dashboard, x, y): the first slot, row by row, where a rectangle fits; the grid is a bounded set of slots."""
    slots = widgets.select(dashboard).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(rows - height)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(columns - width))))
    w = widgets.select(F.col(dashboard).alias("d"), F.col("x").alias("wx"), F.col("y").alias("wy"), "w", "h")
    hit = (slots[dashboard] == w["d"]) & (F.col("x") < F.col("wx") + F.col("w")) & (F.col("wx") < F.col("x") + width) & (F.col("y") < F.col("wy") + F.col("h")) & (F.col("wy") < F.col("y") + height)
    return slots.join(w, hit, "left_anti").groupBy(dashboard).agg(F.min(F.struct("y", "x")).alias("s")).select(dashboard, "s.x", "s.y")
