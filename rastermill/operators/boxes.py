"""Overlap of boxes and non-maximum suppression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from ..functions.store import Scratch


def overlap(a: str, b: str, compat: bool = False) -> Column:
    """Intersection over union of boxes a.(anchor_r, anchor_c, window_h, window_w) and b's.

    compat: rows pair with widths and columns with heights; square boxes don't differ.
    """
    h, w = ("window_w", "window_h") if compat else ("window_h", "window_w")

    def shared(anchor: str, n: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(f"{a}.{anchor}") + F.col(f"{a}.{n}"), F.col(f"{b}.{anchor}") + F.col(f"{b}.{n}")) - F.greatest(F.col(f"{a}.{anchor}"), F.col(f"{b}.{anchor}")))

    both = shared("anchor_r", h) * shared("anchor_c", w)
    return both / (F.col(f"{a}.window_h") * F.col(f"{a}.window_w") + F.col(f"{b}.window_h") * F.col(f"{b}.window_w") - both)


def overlapping_pairs(boxes: DataFrame, threshold: float, compat: bool = False) -> DataFrame:
    """Rows (image_id, a, b, overlap) of boxes a and b, a of smaller rank, that overlap by the threshold or more.

    Boxes meet in the cells of a grid as large as the largest box: each is
    listed in the cells it touches, a pair counts in the cell of its
    intersection's corner.
    """
    cell = boxes.groupBy("image_id").agg(F.max(F.greatest("window_h", "window_w")).alias("cell"))
    rows = boxes.join(cell, "image_id")
    listed = rows.select(
        "image_id", "cell", F.struct("rank", "anchor_r", "anchor_c", "window_h", "window_w").alias("box"),
        F.explode(F.sequence(F.floor(F.col("anchor_r") / F.col("cell")), F.floor((F.col("anchor_r") + F.col("window_h") - 1) / F.col("cell")))).alias("gr"),
        "anchor_c", "window_w",
    ).select("image_id", "cell", "box", "gr", F.explode(F.sequence(F.floor(F.col("anchor_c") / F.col("cell")), F.floor((F.col("anchor_c") + F.col("window_w") - 1) / F.col("cell")))).alias("gc"))
    a, b = listed.withColumnRenamed("box", "x"), listed.drop("cell").withColumnRenamed("box", "y")
    pairs = a.join(shuffled(b), ["image_id", "gr", "gc"]).where("x.rank < y.rank")
    corner = (F.floor(F.greatest("x.anchor_r", "y.anchor_r") / F.col("cell")) == F.col("gr")) & (F.floor(F.greatest("x.anchor_c", "y.anchor_c") / F.col("cell")) == F.col("gc"))
    return pairs.where(corner).select("image_id", F.col("x.rank").alias("a"), F.col("y.rank").alias("b"), overlap("x", "y", compat).alias("overlap")).where(F.col("overlap") >= threshold)


#: Boxes of an image that one task suppresses at most; larger images take rounds over many tasks.
MOST_BOXES = 1 << 16


def _greedy(threshold: float, compat: bool):
    """Greedy suppression of one image's boxes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "ordinal"], ascending=[False, True], ignore_index=True, na_position="last")
        r, c, h, w = (rows[k].to_numpy("float64") for k in ("anchor_r", "anchor_c", "window_h", "window_w"))
        down, right = (w, h) if compat else (h, w)
        left, kept = rows.index.to_numpy(), []
        while len(left):
            best, left = left[0], left[1:]
            kept.append(best)
            both = (np.minimum(r[best] + down[best], r[left] + down[left]) - np.maximum(r[best], r[left])).clip(0) * (np.minimum(c[best] + right[best], c[left] + right[left]) - np.maximum(c[best], c[left])).clip(0)
            left = left[both / (h[best] * w[best] + h[left] * w[left] - both) < threshold]
        return rows.iloc[kept]

    return run


def non_maximum_suppression(boxes: DataFrame, threshold: float, compat: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Boxes that greedy suppression keeps: best score first (ties to the smaller ordinal), dropping what overlaps it by the threshold or more.

    Images of up to MOST_BOXES boxes are a task each.  For larger ones, each
    round keeps all boxes without a better one left among their overlaps and
    drops those that overlap them, which comes to the same boxes; rounds are
    written, and as many as the longest chain of suppressions.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    scratch = scratch or Scratch(boxes.sparkSession, "nms")
    boxes = scratch.save(boxes, "boxes")
    large = scratch.save(boxes.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_BOXES).select("image_id"), "large")
    some = not large.isEmpty()
    small = boxes.join(large, "image_id", "left_anti").select(*boxes.columns) if some else boxes
    kept = small.groupBy("image_id").applyInPandas(_greedy(threshold, compat), small.schema)
    return kept.unionByName(_in_rounds(boxes.join(large, "image_id", "left_semi"), threshold, compat, scratch)) if some else kept


def _in_rounds(boxes: DataFrame, threshold: float, compat: bool, scratch: Scratch) -> DataFrame:
    """Suppression in images of any size."""
    ranked = boxes.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "ordinal")))
    ranked = scratch.save(ranked, "ranked")
    pairs = scratch.save(overlapping_pairs(ranked, threshold, compat).select("image_id", "a", "b"), "pairs")
    left, dropped, turn = pairs, None, 0
    while True:
        # a box that is better than another and worse than none is kept; what it overlaps is dropped
        best = left.select("image_id", "a").distinct().join(shuffled(left.select("image_id", F.col("b").alias("a")).distinct()), ["image_id", "a"], "left_anti")
        gone = scratch.save(left.join(shuffled(best), ["image_id", "a"], "left_semi").select("image_id", F.col("b").alias("rank")).distinct(), f"gone-{turn}")
        if gone.isEmpty():
            break
        dropped = gone if dropped is None else dropped.unionByName(gone)
        left = left.join(shuffled(gone.withColumnRenamed("rank", "a")), ["image_id", "a"], "left_anti").join(shuffled(gone.withColumnRenamed("rank", "b")), ["image_id", "b"], "left_anti").select("image_id", "a", "b")
        left = scratch.save(left, f"left-{turn}")
        turn += 1
    return (ranked if dropped is None else ranked.join(shuffled(dropped), ["image_id", "rank"], "left_anti")).drop("rank")


def recovered(x: Column, resized: Column, original: Column) -> Column:
    """A coordinate or length of a resized image in the original, truncated."""
    return (x * (original / resized)).cast("int")
