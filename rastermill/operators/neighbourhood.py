"""Neighbourhood operators over pixel relations: convolution, gradients, histograms of them, morphology, distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import shuffled

KEY = "image_id"


def disk(n: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= n * n]


def _offsets(pairs: list[tuple]) -> Column:
    names = ("dr", "dc", "w")
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, p, strict=False)]) for p in pairs])


def _scattered(pixels: DataFrame, pairs: list[tuple], *keep: str) -> DataFrame:
    """Each pixel at each place p for which it is p + offset."""
    rows = pixels.select(KEY, "r", "c", *keep, F.explode(_offsets(pairs)).alias("o"))
    return rows.select(KEY, (F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), *keep, *([F.col("o.w").alias("w")] if len(pairs[0]) > 2 else []))


#: Rows of an image that meet its size together.
BAND = 512


def with_sizes(images: DataFrame, rows: DataFrame, r: str = "r") -> DataFrame:
    """Rows above the last row of their image, with its size; they meet by bands, so that a large image is no one task's work."""
    bands = images.where("height > 0").select(KEY, "height", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("height") - 1) / BAND))).alias("_band"))
    return rows.withColumn("_band", F.floor(F.greatest(F.col(r), F.lit(0)) / BAND)).join(shuffled(bands), [KEY, "_band"]).drop("_band").where(F.col(r) < F.col("height"))


def _inside(images: DataFrame, rows: DataFrame) -> DataFrame:
    return with_sizes(images, rows.where("r >= 0 and c >= 0")).where("r < height and c < width")


def row_spans(mask: DataFrame) -> DataFrame:
    """Foreground as rows (image_id, r, c0, c1) of consecutive pixels."""
    group = F.col("c") - F.dense_rank().over(Window.partitionBy(KEY, "r").orderBy("c"))
    return mask.select(KEY, "r", "c", group.alias("g")).groupBy(KEY, "r", "g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("g")


def span_pixels(spans: DataFrame) -> DataFrame:
    return spans.select(KEY, "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def _clipped(spans: DataFrame, images: DataFrame) -> DataFrame:
    rows = spans.join(images.select(KEY, "height", "width"), KEY).where("r >= 0 and r < height and c1 >= 0 and c0 < width")
    kind = dict(spans.dtypes)["c0"]
    return rows.select(KEY, "r", F.greatest("c0", F.lit(0)).cast(kind).alias("c0"), F.least("c1", F.col("width") - 1).cast(kind).alias("c1"))


def _grown(spans: DataFrame, images: DataFrame, n: int) -> DataFrame:
    """Spans grown by disk(n): each goes to 2n + 1 rows, longer by that row's half width, and those that meet are joined."""
    shifts = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(math.isqrt(n * n - a * a)).alias("w")) for a in range(-n, n + 1)])
    rows = spans.select("*", F.explode(shifts).alias("o")).select(KEY, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c0") - F.col("o.w")).alias("c0"), (F.col("c1") + F.col("o.w")).alias("c1"))
    line = Window.partitionBy(KEY, "r").orderBy("c0", "c1")
    so_far = F.max("c1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = _clipped(rows, images).withColumn("new", F.coalesce(F.col("c0") > so_far + 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("g", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(KEY, "r", "g").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("g")


def _gaps(spans: DataFrame, images: DataFrame) -> DataFrame:
    """What spans leave of their images; each row ends in a span beyond the image."""
    kinds = dict(spans.dtypes)
    ends = images.where("height > 0 and width > 0").select(KEY, F.explode(F.sequence(F.lit(0).cast(kinds["r"]), (F.col("height") - 1).cast(kinds["r"]))).alias("r"), F.col("width").cast(kinds["c0"]).alias("c0"), F.col("width").cast(kinds["c1"]).alias("c1"))
    before = F.lag("c1").over(Window.partitionBy(KEY, "r").orderBy("c0"))
    rows = _clipped(spans, images).unionByName(ends).select(KEY, "r", F.coalesce(before + 1, F.lit(0)).cast(kinds["c0"]).alias("c0"), (F.col("c0") - 1).alias("c1"))
    return rows.where("c0 <= c1")


def _shrunk(spans: DataFrame, images: DataFrame, n: int) -> DataFrame:
    return _gaps(_grown(_gaps(spans, images), images, n), images)


#: Kernels of more places than this go by spans of rows (masks) or over tiles (values); smaller ones copy each pixel to each place.
SCATTER_PLACES = 25


def dilate(mask: DataFrame, images: DataFrame, n: int = 1) -> DataFrame:
    """Foreground (image_id, r, c) grown by disk(n).

    Beyond small disks masks travel as spans of their rows: what is shuffled is
    spans times 2n + 1 rows, not pixels times the disk's area.
    """
    if len(disk(n)) > SCATTER_PLACES:
        return span_pixels(_grown(row_spans(mask), images, n))
    return _inside(images, _scattered(mask, disk(n)).distinct()).select(KEY, "r", "c")


def erode(mask: DataFrame, images: DataFrame, n: int = 1) -> DataFrame:
    """Foreground whose disk(n), as far as it lies in the image, is foreground; by spans it is what the grown background leaves."""
    if len(disk(n)) > SCATTER_PLACES:
        return span_pixels(_shrunk(row_spans(mask), images, n))
    there = F.size(F.filter(_offsets(disk(n)), lambda o: (F.col("r") + o["dr"] >= 0) & (F.col("r") + o["dr"] < F.col("height")) & (F.col("c") + o["dc"] >= 0) & (F.col("c") + o["dc"] < F.col("width"))))
    counted = _scattered(mask, disk(n)).groupBy(KEY, "r", "c").agg(F.count("*").alias("k"))
    return _inside(images, counted).where(F.col("k") == there).select(KEY, "r", "c")


def opening(mask: DataFrame, images: DataFrame, n: int = 1) -> DataFrame:
    if len(disk(n)) > SCATTER_PLACES:
        return span_pixels(_grown(_shrunk(row_spans(mask), images, n), images, n))
    return dilate(erode(mask, images, n), images, n)


def closing(mask: DataFrame, images: DataFrame, n: int = 1) -> DataFrame:
    if len(disk(n)) > SCATTER_PLACES:
        return span_pixels(_shrunk(_grown(row_spans(mask), images, n), images, n))
    return erode(dilate(mask, images, n), images, n)


def _extreme(pixels: DataFrame, images: DataFrame, half_widths: list[int], least: bool) -> DataFrame:
    """The least or greatest v around each place of an image, over rows -n..n that reach half_widths[k] to either side."""
    n = len(half_widths) // 2
    places = [(k - n, b) for k, w in enumerate(half_widths) for b in range(-w, w + 1)]
    if len(places) <= SCATTER_PLACES:
        return _inside(images, _scattered(pixels, places, "v").groupBy(KEY, "r", "c").agg((F.min if least else F.max)("v").alias("v"))).select(KEY, "r", "c", "v")
    reach = max(n, *half_widths)
    side = max(128, 4 * reach)
    tiles = lambda x: F.explode(F.sequence(F.floor((F.col(x) - reach) / side), F.floor((F.col(x) + reach) / side)))
    rows = pixels.where("v is not null").select(KEY, "r", "c", F.col("v").cast("double").alias("v"), tiles("r").alias("tr")).select("*", tiles("c").alias("tc"))
    rows = rows.where("tr >= 0 and tc >= 0").groupBy(KEY, "tr", "tc").agg(F.collect_list(F.struct(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v")).alias("p"))
    kinds = dict(pixels.dtypes)
    found = rows.mapInArrow(_tile_extremes(half_widths, reach, side, least), f"{KEY} {kinds[KEY]}, r int, c int, v double")
    found = found.select(KEY, *[F.col(x).cast(kinds[x]).alias(x) for x in ("r", "c", "v")])
    return _inside(images, found).select(KEY, "r", "c", "v")


def _tile_extremes(half_widths: list[int], reach: int, side: int, least: bool):
    """Extremes within a tile from its pixels and those up to `reach` around it; running extremes by doubled lengths."""
    pick, nothing = (np.minimum, np.inf) if least else (np.maximum, -np.inf)

    def along(a: np.ndarray, w: int) -> np.ndarray:
        length, out = 1, a
        while length < 2 * w + 1:  # extremes of `length` places from each on
            step = min(length, 2 * w + 1 - length)
            out = pick(out[:, : out.shape[1] - step], out[:, step:])
            length += step
        return out[:, reach - w : reach - w + side]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                top, left = batch.column("tr")[k].as_py() * side, batch.column("tc")[k].as_py() * side
                p = batch.column("p")[k].values
                r, c, v = (p.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                a = np.full((side + 2 * reach, side + 2 * reach), nothing)
                pick.at(a, (r - top + reach, c - left + reach), v)
                out, by_width = np.full((side, side), nothing), {}
                n = len(half_widths) // 2
                for i, w in enumerate(half_widths):
                    if w not in by_width:
                        by_width[w] = along(a, w)
                    first = reach + i - n
                    out = pick(out, by_width[w][first : first + side])
                rr, cc = np.nonzero(out != nothing)
                ids = batch.column(0).take(pa.array(np.full(len(rr), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array((rr + top).astype(np.int32)), pa.array((cc + left).astype(np.int32)), pa.array(out[rr, cc])], names=[KEY, "r", "c", "v"])

    return run


def _disk_widths(n: int) -> list[int]:
    return [math.isqrt(n * n - a * a) for a in range(-n, n + 1)]


def gray_erode(pixels: DataFrame, images: DataFrame, n: int = 1) -> DataFrame:
    """The least value of each place's disk(n), as far as it lies in the image."""
    return _extreme(pixels, images, _disk_widths(n), True)


def gray_dilate(pixels: DataFrame, images: DataFrame, n: int = 1) -> DataFrame:
    """The greatest value of each place's disk(n), as far as it lies in the image."""
    return _extreme(pixels, images, _disk_widths(n), False)


def white_tophat(pixels: DataFrame, images: DataFrame, n: int = 1) -> DataFrame:
    """v less its grey opening."""
    opened = gray_dilate(gray_erode(pixels, images, n), images, n).withColumnRenamed("v", "o")
    return pixels.join(shuffled(opened), [KEY, "r", "c"]).select(KEY, "r", "c", (F.col("v") - F.col("o")).alias("v"))


def local_maxima(pixels: DataFrame, images: DataFrame, distance: int, threshold: float | None = None) -> DataFrame:
    """Pixels that no pixel within `distance` on either axis exceeds, above the threshold (default: their image's minimum)."""
    top = _extreme(pixels, images, [distance] * (2 * distance + 1), False).withColumnRenamed("v", "top")
    out = pixels.join(shuffled(top), [KEY, "r", "c"]).where("v = top")
    if threshold is None:
        return out.join(pixels.groupBy(KEY).agg(F.min("v").alias("least")), KEY).where("v > least").select(KEY, "r", "c", "v")
    return out.where(F.col("v") > threshold).select(KEY, "r", "c", "v")


def convolve(pixels: DataFrame, kernel: list[tuple[int, int, float]]) -> DataFrame:
    """Sum of w * v[r + dr, c + dc] over kernel rows (dr, dc, w); pixels outside count nothing."""
    total = _scattered(pixels, kernel, "v").groupBy(KEY, "r", "c").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return total.join(shuffled(pixels.select(KEY, "r", "c")), [KEY, "r", "c"], "left_semi")


def sobel(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Gradient magnitude sqrt((h^2 + v^2) / 2) with weights 1/4, 2/4, 1/4; 0 on the image's border."""
    weights = [(-1, 0.25), (0, 0.5), (1, 0.25)]
    pairs = [(a, b, (float(-a) * dict(weights)[b], float(-b) * dict(weights)[a])) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    rows = pixels.select(KEY, "r", "c", "v", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(h).alias("h"), F.lit(x).alias("x")) for a, b, (h, x) in pairs])).alias("o"))
    sums = rows.groupBy(KEY, (F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c")).agg(F.sum(F.col("v") * F.col("o.h")).alias("h"), F.sum(F.col("v") * F.col("o.x")).alias("x"))
    border = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.col("height") - 1) | (F.col("c") == F.col("width") - 1)
    return _inside(images, sums).select(KEY, "r", "c", F.when(border, 0.0).otherwise(F.sqrt((F.col("h") ** 2 + F.col("x") ** 2) / 2)).alias("v"))


def centered_gradient(pixels: DataFrame) -> DataFrame:
    """gx = v[c - 1] - v[c + 1] and gy likewise by rows, as true convolution has it; edges repeat themselves."""
    x, y = Window.partitionBy(KEY, "r").orderBy("c"), Window.partitionBy(KEY, "c").orderBy("r")
    side = lambda f, w: F.coalesce(f("v").over(w), F.col("v"))
    return pixels.select(KEY, "r", "c", (side(F.lag, x) - side(F.lead, x)).alias("gx"), (side(F.lag, y) - side(F.lead, y)).alias("gy"))


def orientation_strength(gradient: DataFrame, unsigned: bool = True) -> DataFrame:
    angle = F.atan2("gy", "gx")
    angle = F.when(F.col("gy") < 0, angle + math.pi).otherwise(angle) if unsigned else angle
    return gradient.select(KEY, "r", "c", angle.alias("orientation"), F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("strength"))


def hog_cells(pixels: DataFrame, images: DataFrame, cell: int = 8, bins: int = 9) -> DataFrame:
    """Rows (image_id, cr, cc, bin, total): strength by orientation of each whole cell, empty bins included."""
    step = math.pi / bins
    rows = orientation_strength(centered_gradient(pixels))
    at = F.least(F.floor(F.col("orientation") / step), F.lit(bins - 1)).cast("int")
    sums = rows.groupBy(KEY, F.floor(F.col("r") / cell).cast("int").alias("cr"), F.floor(F.col("c") / cell).cast("int").alias("cc"), at.alias("bin")).agg(F.sum("strength").alias("total"))
    grid = images.select(KEY, F.explode(F.sequence(F.lit(0), F.floor(F.col("height") / cell).cast("int") - 1)).alias("cr"), "width")
    grid = grid.select(KEY, "cr", F.explode(F.sequence(F.lit(0), F.floor(F.col("width") / cell).cast("int") - 1)).alias("cc")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(sums, [KEY, "cr", "cc", "bin"], "left").fillna(0.0, ["total"])


def hog_blocks(cells: DataFrame, epsilon: float = 1.0, block: int = 2) -> DataFrame:
    """Rows (image_id, br, bc, k, value): each value of a block's cells by sqrt(value^2 + epsilon^2).

    Blocks step by one cell; the last row and column of blocks stay 0.
    """
    bins = F.max("bin").over(Window.partitionBy(KEY)) + 1
    ends = Window.partitionBy(KEY)
    sized = cells.withColumns({"bins": bins, "nr": F.max("cr").over(ends) + 1, "nc": F.max("cc").over(ends) + 1})
    parts = [(a, b) for a in range(block) for b in range(block)]
    rows = sized.select("*", F.explode(_offsets(parts)).alias("o"))
    rows = rows.withColumns({"br": F.col("cr") - F.col("o.dr"), "bc": F.col("cc") - F.col("o.dc")}).where("br >= 0 and bc >= 0 and br < nr - 1 and bc < nc - 1")
    live = (F.col("br") < F.col("nr") - block) & (F.col("bc") < F.col("nc") - block)
    value = F.when(live, F.col("total") / F.sqrt(F.col("total") ** 2 + epsilon**2)).otherwise(0.0)
    return rows.select(KEY, "br", "bc", ((F.col("o.dr") * block + F.col("o.dc")) * F.col("bins") + F.col("bin")).alias("k"), value.alias("value"))


def gaussian_kernel(height: int, width: int, sigma: float, truncate: float = 4.0) -> list[tuple[int, int, float]]:
    """A unit impulse at the centre under a Gaussian filter with reflected edges: (r, c, weight)."""
    reach = int(truncate * sigma + 0.5)
    one = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(one)

    def axis(n: int) -> list[float]:
        out = [0.0] * n
        for i in range(n):
            for k in range(-reach, reach + 1):
                x = (i + k) % (2 * n)
                if (2 * n - 1 - x if x >= n else x) == n // 2:
                    out[i] += one[k + reach] / total
        return out

    rows, cols = axis(height), axis(width)
    return [(r, c, rows[r] * cols[c]) for r in range(height) for c in range(width)]


def gaussian_features(windows: DataFrame, height: int, width: int, sigmas: tuple[float, ...]) -> DataFrame:
    """Rows (image_id, sigma, feature): sum of kernel times image; the kernel table has height * width rows for each sigma."""
    spark = windows.sparkSession
    kernel = spark.createDataFrame([(float(s), r, c, w) for s in sigmas for r, c, w in gaussian_kernel(height, width, s)], "sigma double, r int, c int, w double")
    return windows.join(F.broadcast(kernel), ["r", "c"]).groupBy(KEY, "sigma").agg(F.sum(F.col("v") * F.col("w")).alias("feature"))


def squared_distances(mask: DataFrame, images: DataFrame) -> DataFrame:
    """Rows (image_id, r, c, d2): squared distance of each foreground pixel to the nearest background pixel of its image.

    Two passes: the nearest background along each column, then the least over
    the columns of a row, for which each row travels as arrays.  Null where the
    image has no background.
    """
    grid = images.select(KEY, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r")).select(KEY, "r", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"))
    rows = grid.join(shuffled(mask.select(KEY, "r", "c").withColumn("on", F.lit(1))), [KEY, "r", "c"], "left")
    off = F.when(F.col("on").isNull(), F.col("r"))
    down, up = Window.partitionBy(KEY, "c").orderBy("r"), Window.partitionBy(KEY, "c").orderBy(F.desc("r"))
    rows = rows.withColumn("g", F.least(F.col("r") - F.last(off, True).over(down), F.last(off, True).over(up) - F.col("r")))
    lines = rows.groupBy(KEY, "r").agg(F.array_sort(F.collect_list(F.struct("c", F.coalesce("g", F.lit(-1)).alias("g"), F.col("on").isNotNull().alias("on")))).alias("line"))
    lines = lines.select(KEY, "r", F.col("line.g").alias("g"), F.col("line.on").alias("on"))
    return lines.mapInArrow(_along_rows, f"{KEY} {dict(images.dtypes)[KEY]}, r {dict(lines.dtypes)['r']}, c int, d2 long")


def _along_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least (c - k)^2 + g[k]^2 over a row's columns k, at the row's foreground; g is -1 in columns without background."""
    for batch in batches:
        ids, where, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (g, on) in enumerate(zip(batch.column("g"), batch.column("on"), strict=True)):
            g, on = g.values.to_numpy(zero_copy_only=False).astype(np.int64), on.values.to_numpy(zero_copy_only=False)
            c = np.flatnonzero(on)
            ids.append(np.full(len(c), k))
            where.append(c)
            found.append(_least_parabola(g)[c])
        take, d2 = pa.array(np.concatenate(ids)), np.concatenate(found)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(where), pa.int32()), pa.array(d2, mask=d2 < 0)], names=[KEY, "r", "c", "d2"])


def _least_parabola(g: np.ndarray) -> np.ndarray:
    """For each column c the least (c - k)^2 + g[k]^2 over the columns k with g[k] >= 0; -1 if there are none.

    The first best k never falls as c grows.  So columns are settled by halves:
    one between two settled ones looks only at what lies between their best
    ones, and each of the log(n) levels looks at about n places in all.
    """
    n, ks = len(g), np.flatnonzero(g >= 0)
    if not len(ks):
        return np.full(n, -1, np.int64)
    height, best, out = g[ks] ** 2, np.zeros(n + 2, np.int64), np.zeros(n, np.int64)
    best[n + 1] = len(ks) - 1  # best[c + 1] is column c's; the ends bound all
    step = 1 << max(n.bit_length() - 1, 0)
    while step:
        c = np.arange(step - 1, n, 2 * step)
        lo, hi = best[c + 1 - step], best[np.minimum(c + 1 + step, n + 1)]
        size = hi - lo + 1
        start = np.cumsum(size) - size
        k = np.arange(size.sum()) - np.repeat(start - lo, size)
        value = (np.repeat(c, size) - ks[k]) ** 2 + height[k]
        least = np.minimum.reduceat(value, start)
        first = np.where(value == np.repeat(least, size), k, len(ks))
        best[c + 1], out[c] = np.minimum.reduceat(first, start), least
        step //= 2
    return out
