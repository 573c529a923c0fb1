"""Places of rows in one order of all of them, and running sums along it, without one task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import Scratch

#: Bits of a row's place within its partition in monotonically_increasing_id.
_BITS = 33


def _in_parts(rows: DataFrame, order: list[Column | str], scratch: Scratch | None) -> DataFrame:
    """Rows dealt to ranges of the order and sorted there, with the range (_part) and the place in it (_place); saved, so that they stay."""
    scratch = scratch or Scratch(rows.sparkSession, "ordinals")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = dealt.withColumns({"_part": F.shiftright("_at", _BITS), "_place": F.col("_at").bitwiseAND((1 << _BITS) - 1)}).drop("_at")
    return scratch.save(dealt, "dealt")


def numbered(rows: DataFrame, order: list[Column | str], name: str = "nth", scratch: Scratch | None = None) -> DataFrame:
    """Rows with their place, from 1, in an order of all of them.

    The order is cut into ranges, each sorted by a task of its own; what meets
    in one task is a row for each range.  A range is no larger than its share
    unless rows are equal in the order.
    """
    dealt = _in_parts(rows, order, scratch)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def numbered_by(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "nth", total: str = "n", scratch: Scratch | None = None) -> DataFrame:
    """Rows with their place in the order within their group, and their group's size; a group may be any share of all rows."""
    if not keys:
        return numbered(rows, order, name, scratch).withColumn(total, F.lit(rows.count()))
    every = numbered(rows, [*keys, *order], "_nth", scratch)
    groups = every.groupBy(*keys).agg(F.min("_nth").alias("_first"), F.count("*").alias(total))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"e.{k}").eqNullSafe(F.col(f"g.{k}"))
    found = every.alias("e").join(groups.alias("g"), same).select("e.*", F.col("g._first"), F.col(f"g.{total}"))
    return found.withColumn(name, F.col("_nth") - F.col("_first") + 1).drop("_nth", "_first")


def running_sums(rows: DataFrame, keys: list[str], order: str | list[Column | str], values: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Rows with each value's sum over the rows of their group up to and including them in the order."""
    order = [order] if isinstance(order, str) else order
    dealt = _in_parts(rows, [*order, *keys], scratch).drop("_place")
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range and group
    totals = dealt.groupBy("_part", *keys).agg(*[F.sum(v).alias(v) for v in values])
    totals = totals.select("_part", *keys, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    found = dealt.withColumns({v: F.sum(v).over(within) for v in values}).join(totals, ["_part", *keys])
    return found.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_part", *[f"_{v}" for v in values])
