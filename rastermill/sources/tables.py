"""Label, region, box and annotation tables, and configuration files."""

from __future__ import annotations

import ast
import configparser
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codec import decoded

LABELS = "ImageId string, EncodedPixels string"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of CSV with a header, whose first name may follow "# "."""
    reader = spark.read.option("header", "true")
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return rows.toDF(*[c.removeprefix("# ") for c in rows.columns])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Run-length labels with their 0-based places."""
    return read_csv(spark, path, LABELS).withColumn("DecodedPixels", decoded("EncodedPixels"))


def read_windows(spark: SparkSession, path: str, height: int | None = None, width: int | None = None, n_channels: int | None = None) -> DataFrame:
    """Stored windows, of one shape if given; the shape filter reaches the scan."""
    rows = spark.read.parquet(path)
    for name, n in (("height", height), ("width", width), ("n_channels", n_channels)):
        rows = rows if n is None else rows.where(F.col(name) == n)
    return rows


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    """Rows (image_id, center_r, center_c) from text files of two numbers a line under a # header.

    image_id is that of the folder `image_id=...` a file is in, as `write_centers`
    names it, and else the file's name, less "roi_center_list_for_" before it.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    name, numbers = F.input_file_name(), F.split(F.trim("value"), r"\s+")
    folder = F.regexp_extract(name, r"/image_id=([^/]*)/[^/]*$", 1)
    plus = lambda x: F.regexp_replace(x, r"\+", "%2B")
    unescaped = F.url_decode(plus(F.url_decode(plus(folder))))  # of the file system's address, and of the writer
    own = F.regexp_replace(F.regexp_extract(name, r"([^/]+?)(\.[^./]*)?$", 1), "^roi_center_list_for_", "")
    return rows.select(F.when(folder != "", unescaped).otherwise(own).alias("image_id"), *[numbers[k].cast("double").alias(c) for k, c in enumerate(("center_r", "center_c"))])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rows (picture, pts) from lines "picture,x1,y1,x2,y2,...", blank lines dropped."""
    parts = F.split("value", ",")
    pts = F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / 2).cast("int") - 1), lambda k: F.struct(parts[2 * k + 1].cast("int").alias("x"), parts[2 * k + 2].cast("int").alias("y")))
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts[0].alias("picture"), pts.alias("pts"))


def read_config(path: str) -> dict[str, dict]:
    """INI sections with Python literals as values."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.optionxform = str
    parser.read(path)
    return {s: {k: ast.literal_eval(v) for k, v in parser[s].items()} for s in parser.sections()}


def unzip(archive: str, folder: str) -> None:
    with zipfile.ZipFile(archive) as z:
        z.extractall(folder)
