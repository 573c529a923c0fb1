"""Per-group statistics of values: clipping, rescaling, equalising, standardising, describing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import numbered


def trim_percentiles(rows: DataFrame, keys: list[str], v: str = "v", left: float | None = 1, right: float | None = 99) -> DataFrame:
    """Clamp v to its group's percentiles (linear interpolation); a bound of 0 or None is off."""
    bounds = [b for b in (left, right) if b]
    if not bounds:
        return rows
    cut = rows.groupBy(*keys).agg(F.percentile(v, F.array(*[F.lit(b / 100) for b in bounds])).alias("_cut"))
    out, value = rows.join(cut, keys), F.col(v)
    if left:
        value = F.greatest(value, F.col("_cut")[0])
    if right:
        value = F.least(value, F.col("_cut")[len(bounds) - 1])
    return out.withColumn(v, value).drop("_cut")


def rescale(rows: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """v mapped linearly to [0, 1] by its group's range; 0 where the range is empty."""
    span = rows.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    value = F.when(F.col("_hi") > F.col("_lo"), (F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return rows.join(span, keys).withColumn(v, value).drop("_lo", "_hi")


def equalize(rows: DataFrame, keys: list[str], v: str = "v", bins: int = 256) -> DataFrame:
    """Histogram equalisation: v becomes its group's cumulative share at its bin, of `bins` over the group's range."""
    span = rows.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count("*").alias("_n"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    binned = rows.join(span, keys).withColumn("_bin", at)
    counted = binned.groupBy(*keys, "_bin", "_n").agg(F.count("*").alias("_k"))
    share = counted.select(*keys, "_bin", (F.sum("_k").over(Window.partitionBy(*keys).orderBy("_bin")) / F.col("_n")).alias("_share"))
    return binned.join(share, [*keys, "_bin"]).withColumn(v, F.col("_share")).drop("_bin", "_share", "_lo", "_hi", "_n")


def standardize(rows: DataFrame, keys: list[str], v: str = "v", epsilon: float = 1e-7) -> DataFrame:
    """v less its group's mean, by the population deviation plus epsilon."""
    moments = rows.groupBy(*keys).agg(F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"))
    return rows.join(moments, keys).withColumn(v, (F.col(v) - F.col("_mean")) / (F.col("_sd") + epsilon)).drop("_mean", "_sd")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luminance of 0-255 channels, in [0, 1]."""
    return (0.2125 * r + 0.7154 * g + 0.0721 * b) / 255


def non_black(*channels: Column) -> Column:
    """1 where any channel isn't 0."""
    any_on = channels[0] != 0
    for c in channels[1:]:
        any_on = any_on | (c != 0)
    return any_on.cast("int")


def background_difference(rows: DataFrame, mask: DataFrame, key: str = "image_id", v: str = "v") -> DataFrame:
    """Distance of v from the mean of its image's pixels outside the mask."""
    outside = rows.join(mask.select(key, "r", "c"), [key, "r", "c"], "left_anti").groupBy(key).agg(F.avg(v).alias("_ground"))
    return rows.join(outside, key).withColumn(v, F.abs(F.col(v) - F.col("_ground"))).drop("_ground")


def value_counts(rows: DataFrame, column: str, first: int = 1, last: int | None = None) -> DataFrame:
    """Rows (column, n, rank) by falling count, ties by value; ranks first to last."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ranked = numbered(counted, [F.desc("n"), column], "rank").withColumn("rank", F.col("rank").cast("int"))
    return ranked.where(F.col("rank") >= first) if last is None else ranked.where(F.col("rank").between(first, last))


def describe_string(rows: DataFrame, column: str) -> DataFrame:
    """One row: count, unique values, the most frequent and how often; ties go to the smaller value."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(column).alias("top")))
    return counted.agg(F.sum("n").alias("count"), F.count("*").alias("unique"), best["top"].alias("top"), (-best["k"]).alias("freq"))


def weighted_histogram(rows: DataFrame, keys: list[str], v: str, weight: str, edges: list[float]) -> DataFrame:
    """Rows (keys, bin, total): weights by bin of evenly spaced edges; the last bin is closed."""
    n, lo, hi = len(edges) - 1, edges[0], edges[-1]
    at = F.least(F.floor((F.col(v) - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int")
    return rows.where(F.col(v).between(lo, hi)).groupBy(*keys, at.alias("bin")).agg(F.sum(weight).alias("total"))
