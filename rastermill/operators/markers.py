"""Markers of segments by ultimate erosion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from ..functions.store import Scratch
from . import neighbourhood as nb
from .segmentation import KEY, components

#: Distance of pixels of an image without background.
ENDLESS = 1 << 30


def city_block_distances(mask: DataFrame, images: DataFrame) -> DataFrame:
    """Rows (image_id, r, c, d): steps from each foreground pixel to the nearest background pixel of its image.

    Running minima along columns and then rows, so the work is linear in the
    pixels.  Outside the image isn't background; null where there is none.
    """
    grid = images.select(KEY, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r")).select(KEY, "r", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"))
    rows = grid.join(shuffled(mask.select(KEY, "r", "c").distinct().withColumn("on", F.lit(1))), [KEY, "r", "c"], "left")
    off = F.when(F.col("on").isNull(), F.col("r"))
    down, up = Window.partitionBy(KEY, "c").orderBy("r"), Window.partitionBy(KEY, "c").orderBy(F.desc("r"))
    rows = rows.withColumn("g", F.least(F.col("r") - F.last(off, True).over(down), F.last(off, True).over(up) - F.col("r")))
    right, left = Window.partitionBy(KEY, "r").orderBy("c"), Window.partitionBy(KEY, "r").orderBy(F.desc("c"))
    d = F.least(F.min(F.col("g") - F.col("c")).over(right) + F.col("c"), F.min(F.col("g") + F.col("c")).over(left) - F.col("c"))
    return rows.withColumn("d", d).where("on = 1").select(KEY, "r", "c", "d")


def distances_to(centers: DataFrame, images: DataFrame) -> DataFrame:
    """Rows (image_id, r, c, d): steps from each pixel of the images to the nearest of centers (image_id, r, c); images without centers give none."""
    here = centers.select(KEY, "r", "c").distinct()
    grid = images.select(KEY, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r")).select(KEY, "r", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"))
    away = city_block_distances(grid.join(shuffled(here), [KEY, "r", "c"], "left_anti"), images).where("d is not null")
    return away.select(KEY, "r", "c", F.col("d").cast("int").alias("d")).unionByName(here.select(KEY, "r", "c", F.lit(0).alias("d")))


def last_eroded(mask: DataFrame, images: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows (image_id, r, c, segment): what is left of each part of the mask before erosion by disk(1) would remove it.

    Eroding all parts step by step, keeping those that would vanish and
    following those that split, ends in the flat tops of the city-block
    distance, so these are taken at once.
    """
    scratch = scratch or Scratch(mask.sparkSession, "erosion")
    far = scratch.save(city_block_distances(mask, images).fillna(ENDLESS, ["d"]), "distances")
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    top = nb._scattered(far.withColumn("v", F.col("d")), around, "v").groupBy(KEY, "r", "c").agg(F.max("v").alias("top"))
    flat = scratch.save(components(far, 8, scratch, level="d"), "flat")
    below = far.join(shuffled(top), [KEY, "r", "c"]).where("top > d").join(shuffled(flat), [KEY, "r", "c"]).select(KEY, "segment").distinct()
    return flat.join(below, [KEY, "segment"], "left_anti").select(KEY, "r", "c", "segment")


def ultimate_erosion(mask: DataFrame, images: DataFrame, dilation: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """Markers (image_id, r, c): what erosion leaves last, grown by disk(dilation)."""
    return nb.dilate(last_eroded(mask, images, scratch), images, dilation)


def adaptive_ultimate_erosion(mask: DataFrame, images: DataFrame, dilations: tuple[int, int, int] = (4, 5, 7), larger: int = 600, largest: int = 1000, scratch: Scratch | None = None) -> DataFrame:
    """Markers grown by the size of the segment they are in.

    dilations are those of segments above both bounds, of at most `larger`
    pixels, and of at most `largest`.
    """
    scratch = scratch or Scratch(mask.sparkSession, "erosion")
    labelled = scratch.save(components(mask, 8, scratch), "segments")
    size = labelled.groupBy(KEY, "segment").agg(F.count("*").alias("size"))
    way = F.when(F.col("size") <= larger, 1).when(F.col("size") <= largest, 2).otherwise(0)
    sized = labelled.join(shuffled(size.select(KEY, "segment", way.alias("way"))), [KEY, "segment"]).select(KEY, "r", "c", "way")
    left = scratch.save(last_eroded(mask, images, scratch).select(KEY, "r", "c").join(shuffled(sized), [KEY, "r", "c"]), "left")
    grown = [nb.dilate(left.where(F.col("way") == k), images, n) for k, n in enumerate(dilations)]
    return grown[0].unionByName(grown[1]).unionByName(grown[2]).distinct()
