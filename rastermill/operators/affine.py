"""Affine maps of points and boxes, as the two upper rows of their matrices, of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from .contrast import in_order
from .statistics import standardize

Matrix = list[list[Column]]


def _number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def moving(turn, slant, zooms: tuple, shifts: tuple) -> Matrix:
    """Where a place comes from in an image that is turned and slanted by degrees, zoomed, and then shifted (down, right)."""
    turn, slant = F.radians(_number(turn)), F.radians(_number(slant))
    down, right = (F.lit(1.0) / _number(z) for z in zooms)
    rows = [(F.cos(turn) * down, F.sin(turn + slant) * right), (-F.sin(turn) * down, F.cos(turn + slant) * right)]
    return [[a, b, -a * _number(shifts[0]) - b * _number(shifts[1])] for a, b in rows]


def grid_source(height: Column, width: Column, out: tuple[int, int] = (128, 128), anisotropy: float = 2.15, moved: Matrix | None = None) -> Matrix:
    """Where the places of a grid of size out come from in an image.

    The middles meet; the image is widened to the grid's shape, one row standing
    for `anisotropy` columns.  moved maps the grid's places about its middle first.
    """
    rows, cols = height.cast("double"), width.cast("double")
    tall = cols / rows / anisotropy < out[1] / out[0]
    step = (F.when(tall, rows).otherwise(cols * out[0] / out[1] / anisotropy) / out[0], F.when(tall, rows * out[1] / out[0] * anisotropy).otherwise(cols) / out[1])
    found = []
    for k, middle in enumerate((rows / 2, cols / 2)):
        a, b, c = moved[k] if moved else (F.lit(float(k == 0)), F.lit(float(k == 1)), F.lit(0.0))
        found.append([step[k] * a, step[k] * b, middle + step[k] * (c - a * (out[0] / 2) - b * (out[1] / 2))])
    return found


def apply(m: Matrix, y: Column, x: Column) -> tuple[Column, Column]:
    """(y, x) mapped, truncated toward 0."""
    return tuple((m[k][0] * y + m[k][1] * x + m[k][2]).cast("int") for k in (0, 1))


def clamp_box(x0: Column, y0: Column, x1: Column, y1: Column, height: Column, width: Column) -> list[Column]:
    """A box cut to the image; the whole image if nothing is left."""
    cut = [F.greatest(x0, F.lit(0)), F.greatest(y0, F.lit(0)), F.least(x1, width), F.least(y1, height)]
    empty = (cut[0] >= cut[2]) | (cut[1] >= cut[3])
    return [F.when(empty, whole).otherwise(v) for v, whole in zip(cut, (F.lit(0), F.lit(0), width, height), strict=True)]


def bounding_rectangles(points: DataFrame, key: str) -> DataFrame:
    """Least rectangle around each key's points (x, y)."""
    return points.groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def random_affine(key: str = "image_id", seed: int = 1, out: tuple[int, int] = (128, 128), degrees: float = 5.0, zoom: float = 0.9, shift: float = 0.05) -> Matrix:
    """A small random map for each key: turned and sheared by up to `degrees`, zoomed down to `zoom`, shifted by up to a share of the output; drawn by hash, so reruns agree."""

    def uniform(k: int, low: float, high: float) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(k)))), 1, 8), 16, 10).cast("double")
        return drawn / float(1 << 32) * (high - low) + low

    return moving(uniform(0, -degrees, degrees), uniform(1, -degrees, degrees), (uniform(2, zoom, 1.0), uniform(3, zoom, 1.0)), tuple(uniform(4 + k, -shift * n, shift * n) for k, n in enumerate(out)))


def centered_images(pixels: DataFrame, images: DataFrame, out: tuple[int, int] = (128, 128), anisotropy: float = 2.15, seed: int | None = None) -> DataFrame:
    """Images centred on a grid of size out and standardised; with a seed, moved at random first."""
    moved = transform_images(pixels, images, out, anisotropy, None if seed is None else random_affine(seed=seed, out=out))
    return standardize(moved, ["image_id"])


def transform_images(pixels: DataFrame, images: DataFrame, out: tuple[int, int] = (128, 128), anisotropy: float = 2.15, affine: Matrix | None = None) -> DataFrame:
    """Rows (image_id, r, c, v) of images centred on a grid of size out, by bilinear interpolation; outside is the image's mean.

    affine is a map of the output's places before they are centred.  Each
    output pixel names its four neighbours, which meet the source by equality.
    """
    sized = images.withColumns({"_m": F.array(*[F.array(*row) for row in grid_source(F.col("height"), F.col("width"), out, anisotropy, affine)])})
    grid = sized.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(out[0] - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(out[1] - 1))))
    at = lambda k: F.col("_m")[k][0] * F.col("r") + F.col("_m")[k][1] * F.col("c") + F.col("_m")[k][2]
    grid = grid.withColumns({"sy": at(0), "sx": at(1)}).withColumns({"y0": F.floor("sy").cast("int"), "x0": F.floor("sx").cast("int")})
    inside = (F.col("sy") >= 0) & (F.col("sx") >= 0) & (F.col("sy") <= F.col("height") - 1) & (F.col("sx") <= F.col("width") - 1)
    fy, fx = F.col("sy") - F.col("y0"), F.col("sx") - F.col("x0")
    near = F.array(*[F.struct(F.lit(2 * a + b).alias("corner"), (F.col("y0") + a).alias("y"), (F.col("x0") + b).alias("x"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w")) for a in (0, 1) for b in (0, 1)])
    parts = grid.where(inside).select("image_id", "r", "c", F.explode(near).alias("n")).where("n.w > 0")
    source = pixels.select("image_id", F.col("r").alias("y"), F.col("c").alias("x"), "v")
    sums = parts.select("image_id", "r", "c", F.col("n.y").alias("y"), F.col("n.x").alias("x"), F.col("n.w").alias("w"), F.col("n.corner").alias("corner")).join(shuffled(source), ["image_id", "y", "x"]).groupBy("image_id", "r", "c").agg(in_order("corner", F.col("v") * F.col("w")).alias("v"))
    mean = pixels.groupBy("image_id").agg(F.avg("v").alias("mean"))
    return grid.select("image_id", "r", "c").join(shuffled(sums), ["image_id", "r", "c"], "left").join(mean, "image_id").select("image_id", "r", "c", F.coalesce("v", "mean").alias("v"))
