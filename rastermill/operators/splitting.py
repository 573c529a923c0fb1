"""Splitting segments along lines between their concave points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from ..functions.store import Scratch
from . import contours as ct
from . import shapes
from .segmentation import KEY, closest_pixels, components

KEYS = [KEY, "segment"]
SCORINGS = ("circularity", "convexity", "distance", "intensity", "pointing_angle")


def _hull_values(segments: DataFrame) -> DataFrame:
    """2 on segment pixels, 1 on the rest of their hulls."""
    own = segments.select(*KEYS, "r", "c").distinct().withColumn("v", F.lit(2.0))
    rest = shapes.convex_hull(segments, KEYS).join(shuffled(own), [*KEYS, "r", "c"], "left_anti").withColumn("v", F.lit(1.0))
    return own.unionByName(rest)


def non_convex_points(segments: DataFrame, option: str = "concavity", distance: int = 3, reach: int = 3, max_angle: float = -1.5, min_size: int = 2, factor: float = 2.0, scratch: Scratch | None = None) -> DataFrame:
    """Rows (image_id, segment, nth, y, x, pointing) of points where a segment bends inward.

    concavity: sharp turns of the contour, sharpest of `distance` points to
    either side, angles taken `reach` points away.  closest: of each part of
    the hull outside the segment above min_size, the pixel closest to the
    segment's centre, if not farther than `factor` times the closest of all.
    all: all pixels of the hull outside the filled segment.  pointing is 0 but
    for concavity.
    """
    if option == "concavity":
        named = shapes.contours(_hull_values(segments), KEYS, 1.5).withColumn("of", F.struct(*KEYS, "contour"))
        long = named.groupBy("of").agg(F.count("*").alias("n")).where(F.col("n") > 2 * reach + 1).select("of")
        found = ct.sharp_turns(ct.angles(named.join(shuffled(long), "of", "left_semi"), "of", reach), "of", distance, max_angle)
        order = Window.partitionBy(*KEYS).orderBy("contour", "i")
        return found.select(*KEYS, F.row_number().over(order).alias("nth"), "y", "x", "pointing")
    if option == "closest":
        outside = _hull_values(segments).where("v = 1")
        parts = components(outside.select(F.struct(*KEYS).alias(KEY), "r", "c"), 8, scratch).select(f"{KEY}.*", F.col("segment").alias("part"), "r", "c")
        parts = parts.toDF(*KEYS, "part", "r", "c")
        large = parts.groupBy(*KEYS, "part").agg(F.count("*").alias("n")).where(F.col("n") > min_size)
        middle = segments.groupBy(*KEYS).agg(F.avg("r").alias("center_r"), F.avg("c").alias("center_c"))
        near = closest_pixels(parts, large.join(middle, KEYS).drop("n"), [*KEYS, "part"])
        near = near.withColumn("least", F.min("d2").over(Window.partitionBy(*KEYS))).where(F.col("d2") < factor * F.col("least"))
        return near.select(*KEYS, F.row_number().over(Window.partitionBy(*KEYS).orderBy("part")).alias("nth"), F.col("r").cast("double").alias("y"), F.col("c").cast("double").alias("x"), F.lit(0.0).alias("pointing"))
    if option == "all":
        box = segments.groupBy(*KEYS).agg((F.min("r") - 1).alias("r0"), (F.min("c") - 1).alias("c0"))
        full = shapes.filled(segments, KEYS, scratch).select(f"{KEY}.*", "r", "c").join(box, KEYS).select(*KEYS, (F.col("r") + F.col("r0")).cast("int").alias("r"), (F.col("c") + F.col("c0")).cast("int").alias("c"))
        rest = shapes.convex_hull(segments, KEYS).join(full, [*KEYS, "r", "c"], "left_anti")
        return rest.select(*KEYS, F.row_number().over(Window.partitionBy(*KEYS).orderBy("r", "c")).alias("nth"), F.col("r").cast("double").alias("y"), F.col("c").cast("double").alias("x"), F.lit(0.0).alias("pointing"))
    raise ValueError(f"unknown choice of points: {option}")


def _part_scores(segments: DataFrame, cuts: DataFrame, scoring: str, penalty: float, scratch: Scratch) -> DataFrame:
    """Rows (keys, a, b, score) from the 4-connected parts that each cut leaves."""
    pairs = cuts.select(*KEYS, "a", "b", F.size("line").alias("n"))
    cells = cuts.select(*KEYS, "a", "b", F.explode("line").alias("p")).select(*KEYS, "a", "b", "p.r", "p.c")
    left = segments.join(pairs, KEYS).select(*KEYS, "a", "b", "r", "c").join(cells, [*KEYS, "a", "b", "r", "c"], "left_anti")
    parts = components(left.select(F.struct(*KEYS, "a", "b").alias(KEY), "r", "c"), 4, scratch)
    parts = scratch.save(parts.select(KEY, F.col("segment").alias("part"), "r", "c"), "parts")
    if scoring == "convexity":
        rows = shapes.hull_rows(parts.select(f"{KEY}.*", "part", "r", "c"), [*KEYS, "a", "b", "part"])
        return rows.groupBy(*KEYS, "a", "b").agg(F.sum(F.col("hi") - F.col("lo") + 1).cast("double").alias("score"))
    of = [KEY, "part"]
    area = parts.groupBy(*of).agg(F.count("*").alias("area"))
    around = shapes.outline_length(shapes.filled(parts, of, scratch)).select(f"{KEY}.*", "points").toDF(*of, "points")
    round_ = area.join(around, of).groupBy(KEY).agg(F.avg(F.col("points") / (2 * math.pi * F.sqrt(4 * F.col("area") / math.pi))).alias("mean"))
    return round_.select(f"{KEY}.*", "mean").join(pairs, [*KEYS, "a", "b"]).select(*KEYS, "a", "b", (F.col("n") + penalty * F.col("mean")).alias("score"))


def split_segments(
    segments: DataFrame, values: DataFrame | None = None, threshold: float = 1.0, distance: int = 3, reach: int = 3, max_angle: float = -1.5,
    scoring: str = "circularity", penalty: float = 1.0, limit: float = 0.2, scratch: Scratch | None = None,
) -> DataFrame:
    """Segments (image_id, r, c, segment) less the pixels of each one's best cut.

    A segment whose convex area is above `threshold` times its filled one is
    cut along the line between two of its concave points that scores lowest,
    if it scores under `limit`; the first pair wins ties.  scoring: the line's
    pixels and how far the parts are from circles; the parts' convex area; the
    line's length; the mean of values (image_id, r, c, v) on the line, values
    being distances from the background; or how far the line is from where
    both points point.
    """
    if scoring not in SCORINGS:
        raise ValueError(f"unknown scoring: {scoring}")
    scratch = scratch or Scratch(segments.sparkSession, "splitting")
    segments = scratch.save(segments.select(KEY, "segment", "r", "c").distinct(), "segments")
    bent = shapes.shape_properties(segments, KEYS, scratch).where(F.col("convex_area") / F.col("filled_area") > threshold).select(*KEYS)
    points = scratch.save(non_convex_points(segments.join(shuffled(bent), KEYS, "left_semi"), "concavity", distance, reach, max_angle), "points")
    one, two = (points.select(*KEYS, *[F.col(c).alias(f"{p}{c}") for c in ("nth", "y", "x", "pointing")]) for p in ("a_", "b_"))
    whole = lambda c: F.col(c).cast("int")
    cuts = one.join(shuffled(two), KEYS).where("a_nth < b_nth")
    cuts = cuts.withColumns({"line": shapes.line(whole("a_y"), whole("a_x"), whole("b_y"), whole("b_x")), "a": F.col("a_nth"), "b": F.col("b_nth")})
    dy, dx = F.col("b_y") - F.col("a_y"), F.col("b_x") - F.col("a_x")
    cuts = scratch.save(cuts, "cuts")
    if scoring == "distance":
        scored = cuts.select(*KEYS, "a", "b", F.sqrt(dy**2 + dx**2).alias("score"))
    elif scoring == "pointing_angle":
        off = lambda angle, p: F.abs(ct.positive_angle(angle) - ct.positive_angle(F.col(p)))
        scored = cuts.select(*KEYS, "a", "b", ((off(F.atan2(dx, dy), "a_pointing") + off(F.atan2(-dx, -dy), "b_pointing")) / 2).alias("score"))
    elif scoring == "intensity":
        if values is None:
            raise ValueError("scoring by intensity needs values")
        cells = cuts.select(*KEYS, "a", "b", F.explode("line").alias("p")).select(*KEYS, "a", "b", "p.r", "p.c")
        cells = cells.join(values.select(KEY, "r", "c", "v"), [KEY, "r", "c"]).join(segments.withColumn("own", F.lit(1)), [*KEYS, "r", "c"], "left")
        score = F.avg("v") + F.when(F.count("*") < 2, 1).otherwise(0) + F.when(F.count("own") == 0, 1).otherwise(0)
        scored = cells.groupBy(*KEYS, "a", "b").agg(score.alias("score"))
    else:
        scored = _part_scores(segments, cuts, scoring, penalty, scratch)
    best = scored.where(F.col("score") < limit).groupBy(*KEYS).agg(F.min(F.struct("score", "a", "b")).alias("m")).select(*KEYS, "m.a", "m.b")
    gone = cuts.join(shuffled(best), [*KEYS, "a", "b"]).select(*KEYS, F.explode("line").alias("p")).select(*KEYS, "p.r", "p.c")
    return segments.join(shuffled(gone), [*KEYS, "r", "c"], "left_anti").select(KEY, "r", "c", "segment")


def split_repeatedly(segments: DataFrame, turns: int, values: DataFrame | None = None, scratch: Scratch | None = None, **options) -> DataFrame:
    """Split all segments `turns` times, 4-connected parts becoming segments after each."""
    scratch = scratch or Scratch(segments.sparkSession, "splitting")
    for _ in range(turns):
        cut = split_segments(segments, values, scratch=scratch, **options)
        segments = scratch.save(components(cut.select(KEY, "r", "c").distinct(), 4, scratch), "turn")
    return segments
