"""Joins of rows whose number Spark can't foresee."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows as a side of the next join, in which neither side is broadcast.

    Spark takes exploded rows for as large as what they were exploded from, and
    saved ones for as large as their compressed files; pixels and windows are
    tens to thousands of times that, too many for the driver.
    """
    return rows.hint("merge")
