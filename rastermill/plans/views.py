"""The driver's tables seen as images, masks, windows and points, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from ..functions.store import read_table
from ..operators import statistics, tiling


def px8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 image."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "x"))
    return rows.select("image_id", F.expr("p div 8").cast("int").alias("r"), (F.col("p") % 8).alias("c"), F.col("x").cast("double").alias("v"))


def px64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 embeddings in a row as a 64 x 64 image; what the last image lacks is 0."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("image_id"), (F.col("vec_id") % 64).cast("int").alias("r"), "embedding")
    every = rows.select("image_id").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(63))))
    values = F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64))
    return every.join(shuffled(rows), ["image_id", "r"], "left").select("image_id", "r", F.posexplode(values).alias("c", "x")).select("image_id", "r", "c", F.col("x").cast("double").alias("v"))


def dims(pixels: DataFrame) -> DataFrame:
    """Rows (image_id, height, width)."""
    return pixels.groupBy("image_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))


def above(pixels: DataFrame, share: float) -> DataFrame:
    """Pixels above their image's percentile."""
    cut = pixels.groupBy("image_id").agg(F.percentile("v", F.lit(share)).alias("cut"))
    return pixels.join(cut, "image_id").where("v > cut").select("image_id", "r", "c", "v")


def tiles(mask: DataFrame) -> DataFrame:
    """mask_id by 16 x 16 tiles."""
    return mask.select("image_id", F.expr("(r div 16) * 4 + c div 16").cast("int").alias("mask_id"), "r", "c")


def boxes(spark: SparkSession, sf_dir: str, step: int = 3) -> DataFrame:
    """Unpadded 16 x 16 windows over px64, scored by their mean."""
    pixels = px64(spark, sf_dir)
    windows = tiling.inference_windows(dims(pixels), (16, 16), (step, step), pad=False)
    mean = tiling.window_pixels(windows, pixels).groupBy("image_id", "ordinal").agg(F.round(F.avg("v"), 6).alias("score"))
    return windows.join(shuffled(mean), ["image_id", "ordinal"])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as points: x counts them, y is the value."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read_table(spark, sf_dir, "events").select("user_id", nth.alias("i"), nth.cast("double").alias("x"), F.col("value").alias("y"))


def trimmed_foreground(pixels: DataFrame) -> DataFrame:
    """Pixels above the median once clipped to the 1st and 99th percentiles."""
    return above(statistics.trim_percentiles(pixels, ["image_id"]), 0.5)


PX8 = """px8 AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INT) AS r, CAST((i - 1) % 8 AS INT) AS c, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""
PX64 = """px64 AS (SELECT g.image_id, CAST(g.r AS INT) AS r, CAST(i - 1 AS INT) AS c, coalesce(CAST(embedding[i] AS DOUBLE), 0.0::DOUBLE) AS v
  FROM (SELECT image_id, unnest(range(0, 64)) AS r FROM (SELECT DISTINCT vec_id // 64 AS image_id FROM embeddings)) g LEFT JOIN embeddings e ON e.vec_id = g.image_id * 64 + g.r, (SELECT unnest(range(1, 65)) AS i))"""


def above_sql(name: str, share: float, source: str = "px64") -> str:
    return f"{name} AS (SELECT p.image_id, p.r, p.c, p.v FROM {source} p JOIN (SELECT image_id, quantile_cont(v, {share}) AS cut FROM {source} GROUP BY 1) q USING (image_id) WHERE p.v > q.cut)"


def tiles_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT image_id, CAST((r // 16) * 4 + c // 16 AS INT) AS mask_id, r, c FROM {source})"


BOXES = """grid AS (SELECT CAST(s AS INT) AS s, row_number() OVER (ORDER BY s) - 1 AS k FROM (SELECT unnest(range(0, 49, 3)) AS s)),
boxes AS (SELECT i.image_id, CAST(gc.k * 17 + gr.k AS INT) AS ordinal, gr.s AS anchor_r, gc.s AS anchor_c,
  (SELECT round(avg(v), 6) FROM px64 p WHERE p.image_id = i.image_id AND p.r >= gr.s AND p.r < gr.s + 16 AND p.c >= gc.s AND p.c < gc.s + 16) AS score
  FROM (SELECT DISTINCT image_id FROM px64) i, grid gr, grid gc)"""
POINTS = "points AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS x, value AS y FROM events)"


#: Columns y and x: where places (r, c) of a 6 x 6 grid come from in an 8 x 8 image, the grid moved at random as seed 7 draws it.
_DRAWN = "('0x' || substr(md5(image_id || '-7-{k}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * ({high} - {low}::DOUBLE) + {low}::DOUBLE"
AT_RANDOM = "u AS (SELECT image_id, " + ", ".join(f"{_DRAWN.format(k=k, low=low, high=high)} AS u{k}" for k, (low, high) in enumerate([(-5.0, 5.0), (-5.0, 5.0), (0.9, 1.0), (0.9, 1.0), (-0.3, 0.3), (-0.3, 0.3)])) + """ FROM (SELECT DISTINCT image_id FROM px8)),
drawn AS (SELECT image_id, cos(radians(u0)) / u2 AS a0, sin(radians(u0) + radians(u1)) / u3 AS b0, -sin(radians(u0)) / u2 AS a1, cos(radians(u0) + radians(u1)) / u3 AS b1, u4, u5 FROM u),
map AS (SELECT image_id, a0, b0, -a0 * u4 - b0 * u5 AS c0, a1, b1, -a1 * u4 - b1 * u5 AS c1 FROM drawn)"""
STILL = "map AS (SELECT DISTINCT image_id, 1.0::DOUBLE AS a0, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS a1, 1.0::DOUBLE AS b1, 0.0::DOUBLE AS c1 FROM px8)"


def bilinear_sql(maps: str = STILL) -> str:
    """moved: px8's images on a 6 x 6 grid by bilinear interpolation, outside their mean."""
    return maps + """, grid AS (SELECT map.*, CAST(a AS INT) AS r, CAST(b AS INT) AS c FROM map, (SELECT unnest(range(0, 6)) AS a), (SELECT unnest(range(0, 6)) AS b)),
place AS (SELECT image_id, r, c, 4 + 8 / 6.0::DOUBLE * (a0 * (r - 3) + b0 * (c - 3) + c0) AS y, 4 + 8 / 6.0::DOUBLE * (a1 * (r - 3) + b1 * (c - 3) + c1) AS x FROM grid),
part AS (SELECT image_id, r, c, 2 * a + b AS corner, CAST(floor(y) + a AS INT) AS sr, CAST(floor(x) + b AS INT) AS sc, (CASE a WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE b WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w
  FROM place, (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b) k WHERE y >= 0 AND x >= 0 AND y <= 7 AND x <= 7),
found AS (SELECT part.image_id, part.r, part.c, """ + " + ".join(f"coalesce(max(v * w) FILTER (corner = {k}), 0)" for k in range(4)) + """ AS v FROM part JOIN px8 p ON p.image_id = part.image_id AND p.r = sr AND p.c = sc WHERE w > 0 GROUP BY 1, 2, 3),
moved AS (SELECT grid.image_id, grid.r, grid.c, coalesce(found.v, mean) AS v FROM grid JOIN (SELECT image_id, avg(v) AS mean FROM px8 GROUP BY 1) USING (image_id) LEFT JOIN found USING (image_id, r, c))"""
