"""Run-length codec of foreground pixels: 1-based, column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_major(height: int | Column, r: str = "r", c: str = "c") -> Column:
    """1-based place of a pixel, top to bottom and then left to right."""
    return (F.col(c) * height + F.col(r) + 1).cast("long")


def row_col(place: str, height: int, compat: bool = False) -> tuple[Column, Column]:
    """(row, column) of a 0-based place.  compat: the column is rounded up, so one too high below row 0."""
    col = F.ceil(F.col(place) / height) if compat else F.floor(F.col(place) / height)
    return F.pmod(F.col(place), F.lit(height)).cast("int"), col.cast("int")


def runs(places: DataFrame, keys: list[str], place: str = "p") -> DataFrame:
    """Rows (keys, start, n) of the maximal runs of consecutive places."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(place))
    return places.select(*keys, place, (F.col(place) - nth).alias("island")).groupBy(*keys, "island").agg(F.min(place).alias("start"), F.count("*").alias("n")).drop("island")


def encode(places: DataFrame, keys: list[str], place: str = "p") -> DataFrame:
    """Rows (keys, EncodedPixels): "start length start length ..."."""
    pair = F.struct("start", "n")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.concat_ws(" ", x["start"].cast("string"), x["n"].cast("string"))), " ")
    return runs(places, keys, place).groupBy(*keys).agg(text.alias("EncodedPixels"))


def encode_all(images: DataFrame, places: DataFrame, keys: list[str], place: str = "p") -> DataFrame:
    """As encode, with an empty string for each row of images that has no foreground."""
    return images.select(*keys).distinct().join(encode(places, keys, place), keys, "left").fillna("", ["EncodedPixels"])


def decoded(rle: str) -> Column:
    """Array of the 0-based places of a run-length string; empty for an empty or null one."""
    pairs = F.regexp_extract_all(F.coalesce(F.col(rle), F.lit("")), F.lit(r"\d+ +\d+"), 0)
    runs_ = F.transform(pairs, lambda x: F.struct(F.regexp_substr(x, F.lit(r"^\d+")).cast("long").alias("start"), F.regexp_substr(x, F.lit(r"\d+$")).cast("long").alias("n")))
    return F.flatten(F.transform(F.filter(runs_, lambda x: x["n"] > 0), lambda x: F.sequence(x["start"] - 1, x["start"] + x["n"] - 2)))


def submission(masks: DataFrame, height: int, image: str = "image_id", mask: str | None = None) -> DataFrame:
    """Rows (ImageId, EncodedPixels), one for each mask, of a foreground pixel relation."""
    keys = [image] + ([mask] if mask else [])
    return encode(masks.select(*keys, column_major(height).alias("p")), keys).select(F.col(image).alias("ImageId"), *([mask] if mask else []), "EncodedPixels")
