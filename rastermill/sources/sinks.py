"""Submissions, window tables, centres, reports, images and split folders."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_submission(rows: DataFrame, path: str) -> None:
    """ImageId,EncodedPixels with a header, one row for each segment."""
    rows.select("ImageId", "EncodedPixels").write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_windows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_window_table(rows: DataFrame, path: str) -> None:
    """The window table without its pixels, as CSV; the header's first name follows "# "."""
    rows = rows.drop("image_matrix")
    first = rows.columns[0]
    rows.withColumnRenamed(first, f"# {first}").write.mode("overwrite").option("header", "true").csv(path)


def write_centers(rows: DataFrame, path: str) -> None:
    """Centres as "row column" lines under a # header, one folder with one file for each image; `read_centers` reads them back."""
    lines = rows.select("image_id", F.lit(1).alias("part"), "center_r", "center_c", F.concat_ws(" ", "center_r", "center_c").alias("value"))
    heads = rows.select("image_id").distinct().withColumns({"part": F.lit(0), "value": F.lit("# center_col  center_row")})
    lines = lines.unionByName(heads, allowMissingColumns=True).repartition("image_id").sortWithinPartitions("image_id", "part", "center_r", "center_c")
    lines.select("image_id", "value").write.mode("overwrite").partitionBy("image_id").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """Rows in one folder for each split."""
    rows.write.mode("overwrite").partitionBy(split).parquet(path)


def write_boxes(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def png_bytes(values: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3) array of 0-255 values as PNG."""
    values = np.asarray(values).clip(0, 255).astype(np.uint8)
    h, w = values.shape[:2]
    raw = np.zeros((h, 1 + values[0].size), np.uint8)
    raw[:, 1:] = values.reshape(h, -1)

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if values.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw.tobytes())) + part(b"IEND", b"")


def as_png(images: DataFrame, key: str = "image_id", scale: float = 255.0) -> DataFrame:
    """Rows (key, png) of image rows (key, height, width, data), data times scale."""
    def run(batches):
        for rows in batches:
            rows["png"] = [png_bytes(np.array(d).reshape(h, w) * scale) for h, w, d in zip(rows["height"], rows["width"], rows["data"], strict=True)]
            yield rows[[key, "png"]]

    return images.select(key, "height", "width", "data").mapInPandas(run, f"{key} {dict(images.dtypes)[key]}, png binary")
