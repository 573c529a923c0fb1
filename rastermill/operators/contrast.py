"""Local contrast, edges, and the fixed order of image preprocessing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from ..functions.store import Scratch
from . import neighbourhood as nb
from . import statistics
from .segmentation import components

KEY = nb.KEY


def clahe(pixels: DataFrame, images: DataFrame, tiles: int = 8, clip: float = 0.01, bins: int = 256) -> DataFrame:
    """Contrast-limited adaptive histogram equalisation: (image_id, r, c, v), v in [0, 1].

    An image is cut into tiles * tiles tiles.  Each tile's histogram is clipped
    at `clip` of its pixels (at least 1), what is cut off goes to all bins
    alike, and its running sum maps values; a pixel's value is interpolated
    between the maps of the four nearest tiles.
    """
    scaled = statistics.rescale(pixels.select(KEY, "r", "c", "v"), [KEY]).join(images, KEY)
    scaled = scaled.select(KEY, "r", "c", "height", "width", F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    tile = lambda x, n: F.floor(F.col(x) * tiles / F.col(n)).cast("int")
    counted = scaled.groupBy(KEY, tile("r", "height").alias("tr"), tile("c", "width").alias("tc"), "bin").agg(F.count("*").alias("k"))
    total = counted.groupBy(KEY, "tr", "tc").agg(F.sum("k").alias("n"))
    every = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counted, [KEY, "tr", "tc", "bin"], "left").fillna(0, ["k"])
    most = F.greatest(F.lit(1.0), F.col("n") * clip)
    by = Window.partitionBy(KEY, "tr", "tc")
    # whole numbers add up the same in any order: what bins below the limit hold, and how many bins reach it
    every = every.withColumns({"under": F.when(F.col("k") < most, F.col("k")).otherwise(0), "full": (F.col("k") >= most).cast("long"), "most": most})
    low = lambda w: F.sum("under").over(w) + F.sum("full").over(w) * F.col("most")
    map_ = every.select(KEY, "tr", "tc", "bin", ((low(by.orderBy("bin")) + (F.col("n") - low(by)) / bins * (F.col("bin") + 1)) / F.col("n")).alias("to"))
    place = lambda x, n: (F.col(x) + 0.5) * tiles / F.col(n) - 0.5
    at = scaled.withColumns({"y": place("r", "height"), "x": place("c", "width")})
    inside = lambda t: F.least(F.greatest(t, F.lit(0)), F.lit(tiles - 1)).cast("int")
    y0, x0 = F.floor("y"), F.floor("x")
    fy, fx = F.col("y") - y0, F.col("x") - x0
    near = F.array(*[F.struct(F.lit(2 * a + b).alias("corner"), inside(y0 + a).alias("tr"), inside(x0 + b).alias("tc"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w")) for a in (0, 1) for b in (0, 1)])
    parts = at.select(KEY, "r", "c", "bin", F.explode(near).alias("t")).select(KEY, "r", "c", "bin", "t.*")
    return parts.join(map_, [KEY, "tr", "tc", "bin"]).groupBy(KEY, "r", "c").agg(in_order("corner", F.col("w") * F.col("to")).alias("v"))


def in_order(corner: str, value: Column) -> Column:
    """The sum of a group's values at corners 0 to 3, in this order, so that reruns and other engines agree to the last bit."""
    at = [F.coalesce(F.max(F.when(F.col(corner) == k, value)), F.lit(0.0)) for k in range(4)]
    return at[0] + at[1] + at[2] + at[3]


def process_images(pixels: DataFrame, images: DataFrame, options: dict) -> DataFrame:
    """Preprocess images (image_id, r, c, v, or red, green, blue): grey, trim, norm, sobel, in this order whatever the options'.

    rgb2gray: any value.  trim: two percentiles; fewer leave the values as they
    are.  norm: equal_hist, clahe, or anything else for the full range.
    """
    if "rgb2gray" in options and "red" in pixels.columns:
        pixels = pixels.select(KEY, "r", "c", statistics.gray(F.col("red"), F.col("green"), F.col("blue")).alias("v"))
    if len(options.get("trim") or ()) >= 2:
        pixels = statistics.trim_percentiles(pixels, [KEY], left=options["trim"][0], right=options["trim"][1])
    if "norm" in options:
        if options["norm"] == "equal_hist":
            pixels = statistics.equalize(pixels, [KEY])
        elif options["norm"] == "clahe":
            pixels = clahe(pixels, images)
        else:
            pixels = statistics.rescale(pixels, [KEY])
    if "sobel" in options:
        pixels = nb.sobel(pixels, images)
    return pixels.select(KEY, "r", "c", "v")


def blur(pixels: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian blur along rows, then columns; weights outside the image are left out."""
    reach = int(truncate * sigma + 0.5)
    weights = [(k, math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-reach, reach + 1)]
    here = pixels.select(KEY, "r", "c")
    for kernel in ([(k, 0, w) for k, w in weights], [(0, k, w) for k, w in weights]):
        rows = nb._scattered(pixels, kernel, "v").groupBy(KEY, "r", "c").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
        pixels = rows.join(shuffled(here), [KEY, "r", "c"], "left_semi")
    return pixels


def canny(pixels: DataFrame, images: DataFrame, sigma: float = 2.0, low: float = 0.1, high: float = 0.2, scratch: Scratch | None = None) -> DataFrame:
    """Edge pixels (image_id, r, c).

    Gradient maxima along the gradient's direction of the blurred image, away
    from the border, of at least `low`, in 8-connected runs that somewhere
    reach `high`.
    """
    scratch = scratch or Scratch(pixels.sparkSession, "canny")
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    weight = lambda a, b: float(a * (2 - abs(b)))
    sides = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(weight(a, b)).alias("i"), F.lit(weight(b, a)).alias("j")) for a, b in around])
    moved = blur(pixels, sigma).select(KEY, "r", "c", "v", F.explode(sides).alias("o"))
    slopes = moved.groupBy(KEY, (F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c")).agg(F.sum(F.col("v") * F.col("o.i")).alias("i"), F.sum(F.col("v") * F.col("o.j")).alias("j"))
    inner = nb._inside(images, slopes).where("r > 0 and c > 0 and r < height - 1 and c < width - 1")
    slopes = scratch.save(inner.select(KEY, "r", "c", "i", "j", F.sqrt(F.col("i") ** 2 + F.col("j") ** 2).alias("m")), "slopes")
    # each pixel asks its neighbours on either side along the gradient, two on each by weight
    si, sj = F.signum("i").cast("int"), F.signum("j").cast("int")
    steep = F.abs("i") >= F.abs("j")
    w = F.when(steep, F.abs("j") / F.abs("i")).otherwise(F.abs("i") / F.abs("j"))
    asked = [F.struct(F.lit(s).alias("side"), (F.col("r") + s * dr).alias("r"), (F.col("c") + s * dc).alias("c"), share.alias("w")) for s in (1, -1) for dr, dc, share in ((F.when(steep, si).otherwise(0), F.when(steep, 0).otherwise(sj), 1 - w), (si, sj, w))]
    wanted = slopes.where("m > 0").select(KEY, F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("m").alias("m0"), F.explode(F.array(*asked)).alias("q")).select(KEY, "r0", "c0", "m0", "q.*")
    sides_ = wanted.join(slopes.select(KEY, "r", "c", "m"), [KEY, "r", "c"], "left").groupBy(KEY, "r0", "c0", "m0", "side").agg(F.sum(F.col("w") * F.coalesce("m", F.lit(0.0))).alias("beside"))
    peaks = sides_.groupBy(KEY, "r0", "c0", "m0").agg(F.max("beside").alias("most")).where((F.col("m0") >= F.col("most")) & (F.col("m0") >= low))
    peaks = scratch.save(peaks.select(KEY, F.col("r0").alias("r"), F.col("c0").alias("c"), "m0"), "peaks")
    runs = scratch.save(components(peaks, 8, scratch), "runs")
    strong = runs.join(peaks.where(F.col("m0") >= high), [KEY, "r", "c"], "left_semi").select(KEY, "segment").distinct()
    return runs.join(strong, [KEY, "segment"], "left_semi").select(KEY, "r", "c")


def canny_borders(pixels: DataFrame, images: DataFrame, sigma: float = 2.0, n: int = 2) -> DataFrame:
    """Canny edges, closed by disk(n)."""
    return nb.closing(canny(pixels, images, sigma), images, n)
