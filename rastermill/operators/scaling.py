"""Resized images and detection over pyramids of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import Scratch
from .boxes import non_maximum_suppression
from .contrast import blur

KEY = "image_id"


def resize(pixels: DataFrame, images: DataFrame, sizes: DataFrame) -> DataFrame:
    """Images (image_id, r, c, v) at new sizes (image_id, height, width), by bilinear interpolation; edges repeat.

    Each new pixel names its four neighbours, which meet the source by equality.
    """
    new = sizes.select(KEY, F.col("height").alias("h"), F.col("width").alias("w")).join(images.select(KEY, "height", "width"), KEY)
    grid = new.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    grid = grid.withColumns({"y": (F.col("r") + 0.5) * F.col("height") / F.col("h") - 0.5, "x": (F.col("c") + 0.5) * F.col("width") / F.col("w") - 0.5})
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    inside = lambda p, n: F.least(F.greatest(p, F.lit(0)), F.col(n) - 1).cast("int")
    near = [F.struct(inside(F.floor("y") + a, "height").alias("y"), inside(F.floor("x") + b, "width").alias("x"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("weight")) for a in (0, 1) for b in (0, 1)]
    parts = grid.select(KEY, "r", "c", F.explode(F.array(*near)).alias("n")).select(KEY, "r", "c", "n.*")
    source = pixels.select(KEY, F.col("r").alias("y"), F.col("c").alias("x"), "v")
    return parts.join(source, [KEY, "y", "x"]).groupBy(KEY, "r", "c").agg(F.sum(F.col("v") * F.col("weight")).alias("v"))


def rescale_images(pixels: DataFrame, images: DataFrame, factor: float = 1.0) -> DataFrame:
    """Images resized by a factor, sizes rounded."""
    sized = lambda n: F.greatest(F.round(F.col(n) * factor), F.lit(1)).cast("int").alias(n)
    return resize(pixels, images, images.select(KEY, sized("height"), sized("width")))


def gaussian_pyramid(pixels: DataFrame, images: DataFrame, downscale: float, layers: int, scratch: Scratch | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """Layers (pixels, images): the images, and each time blurred by a third of the scale and shrunk, sizes rounded up."""
    scratch = scratch or Scratch(pixels.sparkSession, "pyramid")
    out = [(pixels.select(KEY, "r", "c", "v"), images.select(KEY, "height", "width"))]
    for _ in range(layers - 1):
        p, i = out[-1]
        smaller = i.select(KEY, F.ceil(F.col("height") / downscale).cast("int").alias("height"), F.ceil(F.col("width") / downscale).cast("int").alias("width"))
        out.append((scratch.save(resize(blur(p, 2 * downscale / 6), i, smaller), "layer"), smaller))
    return out


def detect_in_pyramid(pixels: DataFrame, images: DataFrame, detect: Callable[[DataFrame, DataFrame], DataFrame], downscale: float, layers: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All boxes that detect(pixels, images) finds in any layer, in the places of the first, and those that suppression keeps.

    detect returns (image_id, ordinal, anchor_r, anchor_c, window_h, window_w, score).
    """
    every = None
    for k, (p, i) in enumerate(gaussian_pyramid(pixels, images, downscale, layers)):
        scaled = {c: F.round(F.col(c) * downscale**k).cast("int") for c in ("anchor_r", "anchor_c", "window_h", "window_w")}
        found = detect(p, i).withColumns(scaled).withColumn("layer", F.lit(k))
        every = found if every is None else every.unionByName(found)
    order = F.row_number().over(_by_layer())
    every = every.withColumn("ordinal", order - 1)
    return every, non_maximum_suppression(every, threshold)


def _by_layer():
    from pyspark.sql import Window

    return Window.partitionBy(KEY).orderBy("layer", "ordinal")
