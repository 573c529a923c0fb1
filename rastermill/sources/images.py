"""Images and masks as rows, and as pixel relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.statistics import non_black


def read_images(spark: SparkSession, path: str, glob: str = "*.png", size: tuple[int, int] | None = None) -> DataFrame:
    """Rows (path, image_id, height, width, n_channels, data) of all images under path, optionally of one (height, width).

    image_id is the file's name without its ending; data are bytes in BGR order, row by row.
    """
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("dropInvalid", "true").load(path).select("image.*")
    rows = rows.select(F.col("origin").alias("path"), stem("origin").alias("image_id"), "height", "width", F.col("nChannels").alias("n_channels"), "data")
    return rows if size is None else rows.where((F.col("height") == size[0]) & (F.col("width") == size[1]))


def stem(path: str) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_extract(F.col(path), r"([^/]+?)(\.[^./]*)?$", 1)


def read_image_folders(spark: SparkSession, root: str) -> DataFrame:
    """Images of the layout root/<image_id>/images/<name>.png."""
    return read_images(spark, f"{root}/*/images").withColumn("image_id", F.regexp_extract("path", r"([^/]+)/images/[^/]+$", 1))


def read_mask_folders(spark: SparkSession, root: str) -> DataFrame:
    """Mask images of the layout root/<image_id>/masks/<mask_id>.png, with mask_id."""
    return read_images(spark, f"{root}/*/masks").withColumns({"mask_id": F.col("image_id"), "image_id": F.regexp_extract("path", r"([^/]+)/masks/[^/]+$", 1)})


def image_ids(spark: SparkSession, root: str) -> DataFrame:
    """Folders under root that hold an image."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/*/images").select(F.regexp_extract("path", r"([^/]+)/images/[^/]+$", 1).alias("image_id")).distinct()


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (filename) of the regular files in a folder; their contents aren't read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("filename"))


def file_frame(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.createDataFrame([(f,) for f in files], "filename string")


#: Rows of one Arrow batch of pixels.
BATCH_ROWS = 1 << 18


def pixels(images: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Rows (keys, r, c, ch, v), channels in RGB order, from bytes in BGR order; an image at a time is unpacked by numpy."""
    rows = images.select(*keys, "width", "n_channels", "data")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_unpacked(keys), ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", r int, c int, ch int, v double")


def _unpacked(keys: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in keys]
            for i, (width, n_channels, data) in enumerate(zip(*(batch.column(c) for c in ("width", "n_channels", "data")), strict=True)):
                if not (width.is_valid and n_channels.is_valid and data.is_valid):
                    continue
                width, depth = width.as_py(), n_channels.as_py()
                values = np.frombuffer(data.as_buffer(), np.uint8)
                for start in range(0, len(values), BATCH_ROWS):
                    p = np.arange(start, min(start + BATCH_ROWS, len(values)))
                    place, ch = np.divmod(p, depth)
                    ch = np.where((ch < 3) & (depth >= 3), 2 - ch, ch)
                    r, c = np.divmod(place, width)
                    of = pa.array(np.full(len(p), i))
                    arrays = [*(x.take(of) for x in columns), *(pa.array(x.astype(np.int32)) for x in (r, c, ch)), pa.array(values[p].astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "r", "c", "ch", "v"])

    return run


def channels(pixel_rows: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Rows (keys, r, c, red, green, blue)."""
    pick = lambda k, name: F.max(F.when(F.col("ch") == k, F.col("v"))).alias(name)
    return pixel_rows.groupBy(*keys, "r", "c").agg(pick(0, "red"), pick(1, "green"), pick(2, "blue"))


def mask_pixels(mask_images: DataFrame, keys: tuple[str, ...] = ("image_id", "mask_id"), full_only: bool = False) -> DataFrame:
    """Foreground rows (keys, r, c): any value but 0, or with full_only just 255."""
    rows = pixels(mask_images, keys)
    on = F.col("v") == 255 if full_only else non_black(F.col("v")) == 1
    return rows.where(on).select(*keys, "r", "c").distinct()


def image_frame(pixel_rows: DataFrame, key: str = "image_id") -> DataFrame:
    """One row for each image: (key, height, width, data), data row by row."""
    packed = pixel_rows.groupBy(key).agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"), F.array_sort(F.collect_list(F.struct("r", "c", "v"))).alias("p"))
    return packed.select(key, "height", "width", F.transform("p", lambda x: x["v"]).alias("data"))


def pixel_frame(images: DataFrame, key: str = "image_id") -> DataFrame:
    """Pixels of image_frame rows."""
    rows = images.select(key, "width", F.posexplode("data").alias("p", "v"))
    return rows.select(key, F.expr("p div width").cast("int").alias("r"), (F.col("p") % F.col("width")).cast("int").alias("c"), "v")
