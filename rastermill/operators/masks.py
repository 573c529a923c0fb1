"""Masks as sets of foreground pixels (image_id, r, c): set operations, boxes of masks, regions of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ["image_id", "r", "c"]


def union(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*PIXEL)
    for m in masks[1:]:
        out = out.unionByName(m.select(*PIXEL))
    return out.distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).distinct().join(b.select(*PIXEL), PIXEL, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).distinct().join(b.select(*PIXEL), PIXEL, "left_anti")


def sizes(mask: DataFrame, keys: list[str]) -> DataFrame:
    return mask.groupBy(*keys).agg(F.count("*").alias("size"))


def size_filter(mask: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Segments with low < size < high."""
    return sizes(mask, keys).where((F.col("size") > low) & (F.col("size") < high))


def bounding_boxes(mask: DataFrame, keys: list[str], compat: bool = False) -> DataFrame:
    """Rows (keys, row_min, row_max, col_min, col_max), maxima included.

    compat: columns are rounded up when taken from places, so they are one too
    high for all pixels below row 0.
    """
    col = F.col("c") + F.when(F.col("r") > 0, 1).otherwise(0) if compat else F.col("c")
    return mask.groupBy(*keys).agg(F.min("r").alias("row_min"), F.max("r").alias("row_max"), F.min(col).alias("col_min"), F.max(col).alias("col_max"))


def bounding_boxes_of_runs(labels: DataFrame, images: DataFrame, key: str = "ImageId") -> DataFrame:
    """Boxes, their sizes and the images' sizes from decoded run-length labels (key, DecodedPixels) and (key, height, width)."""
    place = labels.join(images, key).select(key, "height", "width", F.posexplode("DecodedPixels").alias("_i", "p"), "EncodedPixels")
    pixels = place.select(key, "EncodedPixels", "height", "width", F.pmod("p", F.col("height")).alias("r"), F.floor(F.col("p") / F.col("height")).alias("c"))
    box = pixels.groupBy(key, "EncodedPixels", "height", "width").agg(F.min("r").alias("boxminR"), F.max("r").alias("boxmaxR"), F.min("c").alias("boxminC"), F.max("c").alias("boxmaxC"))
    return box.select(key, "boxminR", "boxmaxR", "boxminC", "boxmaxC", (F.col("boxmaxR") - F.col("boxminR")).alias("boxH"), (F.col("boxmaxC") - F.col("boxminC")).alias("boxW"), F.col("width").alias("imgW"), F.col("height").alias("imgH"))


def _clip(x: Column, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(high))


def padded_boxes(boxes: DataFrame, padding: int, height: int, width: int) -> DataFrame:
    """Boxes grown by padding inside the image; upper ends are exclusive from here on."""
    return boxes.withColumns({
        "row_min": F.greatest(F.col("row_min") - padding, F.lit(0)), "row_max": F.least(F.col("row_max") + padding, F.lit(height)),
        "col_min": F.greatest(F.col("col_min") - padding, F.lit(0)), "col_max": F.least(F.col("col_max") + padding, F.lit(width)),
    })


def with_centers(boxes: DataFrame) -> DataFrame:
    """Centre of each box, rounded down."""
    return boxes.withColumns({"center_r": F.floor((F.col("row_max") + F.col("row_min")) / 2).cast("int"), "center_c": F.floor((F.col("col_max") + F.col("col_min")) / 2).cast("int")})


def fixed_boxes(centers: DataFrame, size: tuple[int, int], height: int | None = None, width: int | None = None) -> DataFrame:
    """Boxes of a fixed size around (center_r, center_c): from floor(n / 2) - 1 before; clipped to the image if its size is given."""
    out = {}
    for name, center, n, high in (("row", "center_r", size[0], height), ("col", "center_c", size[1], width)):
        before = n // 2 - 1
        lo, hi = F.col(center) - before, F.col(center) + (n - before)
        out[f"{name}_min"], out[f"{name}_max"] = (lo, hi) if high is None else (_clip(lo, high), _clip(hi, high))
    return centers.withColumns(out)


def square_boxes(boxes: DataFrame, height: int, width: int) -> DataFrame:
    """Boxes widened about their centres to the longer side."""
    side = F.greatest(F.col("row_max") - F.col("row_min"), F.col("col_max") - F.col("col_min"))
    boxes = with_centers(boxes).withColumn("side", side)
    before = F.floor(F.col("side") / 2).cast("int") - 1
    return boxes.withColumns({
        "row_min": _clip(F.col("center_r") - before, height), "row_max": _clip(F.col("center_r") + F.col("side") - before, height),
        "col_min": _clip(F.col("center_c") - before, width), "col_max": _clip(F.col("center_c") + F.col("side") - before, width),
    })


def crop(pixels: DataFrame, boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """Pixels inside each half-open box, with places inside it (wr, wc).

    Boxes reach their pixels by equality: each names the rows it spans.
    """
    spans = boxes.withColumn("r", F.explode(F.sequence(F.col("row_min"), F.col("row_max") - 1))).where("row_max > row_min")
    joined = spans.join(pixels, [key, "r"]).where((F.col("c") >= F.col("col_min")) & (F.col("c") < F.col("col_max")))
    return joined.withColumns({"wr": F.col("r") - F.col("row_min"), "wc": F.col("c") - F.col("col_min")})
