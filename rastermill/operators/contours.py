"""Angles along contours (key, i, y, x) and their sharp turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def angles(points: DataFrame, key: str, distance: int) -> DataFrame:
    """angle between the ways to the points `distance` before and after, and pointing, the way from both; 0 near the ends."""
    w = Window.partitionBy(key).orderBy("i")
    v = {f"{p}{k}": f(c, distance).over(w) - F.col(c) for k, f in ((1, F.lag), (2, F.lead)) for p, c in (("a", "y"), ("b", "x"))}
    rows = points.withColumns(v)
    near_end = F.col("a1").isNull() | F.col("a2").isNull()
    angle = F.atan2(F.col("a1") * F.col("a2") + F.col("b1") * F.col("b2"), F.col("a1") * F.col("b2") - F.col("b1") * F.col("a2"))
    pointing = F.atan2(-F.col("b1") - F.col("b2"), -F.col("a1") - F.col("a2"))
    return rows.select(*points.columns, F.when(near_end, 0.0).otherwise(angle).alias("angle"), F.when(near_end, 0.0).otherwise(pointing).alias("pointing"))


def sharp_turns(contours: DataFrame, key: str, n: int, max_angle: float = -1.5) -> DataFrame:
    """Points whose angle is strictly below those of n neighbours on each side, and below max_angle."""
    w = Window.partitionBy(key).orderBy("i")
    before, after = F.min("angle").over(w.rowsBetween(-n, -1)), F.min("angle").over(w.rowsBetween(1, n))
    rows = contours.withColumns({"_before": before, "_after": after})
    return rows.where((F.col("angle") < F.col("_before")) & (F.col("angle") < F.col("_after")) & (F.col("angle") < max_angle)).drop("_before", "_after")


def positive_angle(angle: Column) -> Column:
    return F.when(angle < 0, angle + F.pi()).otherwise(angle)
