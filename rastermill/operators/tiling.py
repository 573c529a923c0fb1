"""Windows over images: training grids, inference grids, padding, and masks from boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from . import neighbourhood as nb


def _starts(first_past_last: Column, step: Column | int) -> Column:
    """0, step, 2 step ... below first_past_last; empty if none is."""
    step = step if isinstance(step, Column) else F.lit(step)
    return F.when(first_past_last > 0, F.sequence(F.lit(0), first_past_last - 1, step)).otherwise(F.array().cast("array<int>"))


def training_windows(images: DataFrame, size: tuple[int, int], per_edge: int) -> DataFrame:
    """Rows (image_id, row_min, col_min, extract_height, extract_width, index_row, index_col) from (image_id, height, width).

    The step is the free length by windows per edge, at least 1; ends are
    exclusive; the centre is rounded down.
    """
    (h, w), rows = size, images
    for name, dim, n in (("row_min", "height", h), ("col_min", "width", w)):
        free = (F.col(dim) - n).cast("int")
        rows = rows.withColumn(name, F.explode(_starts(free, F.greatest(F.lit(1), F.floor(free / per_edge).cast("int")))))
    center = lambda start, n: F.floor((2 * F.col(start) + n) / 2).cast("int")
    return rows.select("image_id", "height", "width", "row_min", "col_min", F.lit(h).alias("extract_height"), F.lit(w).alias("extract_width"), center("row_min", h).alias("index_row"), center("col_min", w).alias("index_col"))


def label_windows(windows: DataFrame, mask: DataFrame, distance: int, half_open: bool = False) -> DataFrame:
    """is_positive '1' where a mask pixel lies within `distance` of the centre on both axes, else '0'.

    half_open: the upper ends are left out, as in the older labelling.  Pixels
    outside the image are background.
    """
    high = distance - 1 if half_open else distance
    offsets = [(dr, dc) for dr in range(-distance, high + 1) for dc in range(-distance, high + 1)]
    keyed = windows.select("image_id", "index_row", "index_col").distinct()
    if not offsets:
        return windows.withColumn("is_positive", F.lit("0"))
    near = keyed.withColumn("o", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])))
    near = near.select("image_id", "index_row", "index_col", (F.col("index_row") + F.col("o.dr")).alias("r"), (F.col("index_col") + F.col("o.dc")).alias("c"))
    hit = near.join(shuffled(mask.select("image_id", "r", "c")), ["image_id", "r", "c"], "left_semi").select("image_id", "index_row", "index_col").distinct().withColumn("is_positive", F.lit("1"))
    return windows.join(shuffled(hit), ["image_id", "index_row", "index_col"], "left").fillna("0", ["is_positive"])


def window_name(prefix: Column, *parts: str) -> Column:
    return F.concat_ws("_", prefix, *[F.col(p).cast("string") for p in parts])


def inference_windows(images: DataFrame, size: tuple[int, int], step: tuple[int, int], pad: bool = True, compat: bool = False) -> DataFrame:
    """Rows (image_id, ordinal, anchor_r, anchor_c, window_h, window_w) from (image_id, height, width).

    step is (columns, rows).  Starts run to the last that fits the padded
    image; where the padded size isn't a multiple of the step, the last fitting
    start is added.  compat: the width alone decides that, for both axes.
    Anchors are places in the unpadded image; ordinals go column by column.
    """
    (h, w), (step_c, step_r) = size, step
    extra = (2 * (h // 2), 2 * (w // 2)) if pad else (0, 0)
    padded = images.select("image_id", (F.col("height") + extra[0]).cast("int").alias("ph"), (F.col("width") + extra[1]).cast("int").alias("pw"))
    uneven_c, uneven_r = F.col("pw") % step_c > 0, F.col("ph") % step_r > 0
    cols = F.concat(_starts(F.col("pw") + 1 - w, step_c), F.when(uneven_c, F.array(F.col("pw") - w)).otherwise(F.array().cast("array<int>")))
    rows = F.concat(_starts(F.col("ph") + 1 - h, step_r), F.when(uneven_c if compat else uneven_r, F.array(F.col("ph") - h)).otherwise(F.array().cast("array<int>")))
    if not compat:
        cols, rows = F.array_distinct(cols), F.array_distinct(rows)
    grid = padded.select("image_id", rows.alias("rows"), F.posexplode(cols).alias("j", "c")).select("image_id", "j", "c", F.size("rows").alias("n"), F.posexplode("rows").alias("i", "r"))
    return grid.select("image_id", (F.col("j") * F.col("n") + F.col("i")).alias("ordinal"), (F.col("r") - extra[0] // 2).alias("anchor_r"), (F.col("c") - extra[1] // 2).alias("anchor_c"), F.lit(h).alias("window_h"), F.lit(w).alias("window_w"))


def window_pixels(windows: DataFrame, pixels: DataFrame) -> DataFrame:
    """Window rows with their pixels that lie in the image, as (wr, wc, v); rows meet by equality of image and row."""
    spans = windows.withColumn("r", F.explode(F.sequence(F.greatest(F.col("anchor_r"), F.lit(0)), F.greatest(F.col("anchor_r") + F.col("window_h") - 1, F.lit(0)))))
    joined = spans.join(shuffled(pixels), ["image_id", "r"]).where((F.col("c") >= F.col("anchor_c")) & (F.col("c") < F.col("anchor_c") + F.col("window_w")) & (F.col("r") < F.col("anchor_r") + F.col("window_h")))
    return joined.withColumns({"wr": F.col("r") - F.col("anchor_r"), "wc": F.col("c") - F.col("anchor_c")})


def _mirrored(x: Column, n: Column, edge_twice: bool) -> Column:
    """The place inside [0, n) that reflection puts at x, for one reflection."""
    if edge_twice:
        return F.when(x < 0, -x - 1).when(x >= n, 2 * n - 1 - x).otherwise(x)
    return F.when(x < 0, -x).when(x >= n, 2 * n - 2 - x).otherwise(x)


def pad_images(pixels: DataFrame, images: DataFrame, size: tuple[int, int], padding: str = "constant") -> DataFrame:
    """Rows (image_id, r, c, v) of images padded by half a window on each side, with places counted from the padded corner.

    constant fills with the image's median; reflect and symmetric mirror, with
    the edge once or twice; edge repeats it.
    """
    ph, pw = size[0] // 2, size[1] // 2
    grid = images.select("image_id", "height", "width", F.explode(F.sequence(F.lit(0), F.col("height") + 2 * ph - 1)).alias("r"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.col("width") + 2 * pw - 1)).alias("c"))
    sr, sc = F.col("r") - ph, F.col("c") - pw
    if padding == "edge":
        sr, sc = F.least(F.greatest(sr, F.lit(0)), F.col("height") - 1), F.least(F.greatest(sc, F.lit(0)), F.col("width") - 1)
    elif padding in ("reflect", "symmetric"):
        sr, sc = _mirrored(sr, F.col("height"), padding == "symmetric"), _mirrored(sc, F.col("width"), padding == "symmetric")
    elif padding != "constant":
        raise ValueError(f"unknown padding: {padding}")
    grid = grid.withColumns({"sr": sr, "sc": sc})
    source = pixels.select("image_id", F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    out = grid.join(shuffled(source), ["image_id", "sr", "sc"], "left")
    if padding == "constant":
        out = out.join(pixels.groupBy("image_id").agg(F.median("v").alias("fill")), "image_id").withColumn("v", F.coalesce("v", "fill"))
    return out.select("image_id", "r", "c", "v")


def boxes_to_mask(boxes: DataFrame, images: DataFrame, replacement: tuple[int, int] = (1, 1), value: str | None = None) -> DataFrame:
    """Rows (image_id, r, c[, v]) marked by boxes (anchor_r, anchor_c, window_h, window_w).

    The centre is anchor + half the window - 1, at least 0; a block of odd size
    starts there and ends before the image's last row and column, which only a
    block that would be empty marks.  With value, later boxes (by ordinal) win.
    """
    if replacement[0] % 2 == 0 or replacement[1] % 2 == 0:
        raise ValueError("replacement sizes must be odd")
    rows = nb.with_sizes(images, boxes, "anchor_r")
    for axis, anchor, n, dim, size in (("r", "anchor_r", "window_h", "height", replacement[0]), ("c", "anchor_c", "window_w", "width", replacement[1])):
        start = F.greatest(F.lit(0), F.col(anchor) + F.floor(F.col(n) / 2).cast("int") - 1)
        rows = rows.withColumn("_s", start).withColumn("_e", F.least(F.col(dim) - 1, F.col("_s") + size)).where("_e >= _s")
        rows = rows.withColumn(axis, F.explode(F.sequence(F.col("_s"), F.greatest(F.col("_s"), F.col("_e") - 1)))).drop("_s", "_e")
    if value is None:
        return rows.select("image_id", "r", "c").distinct()
    return rows.groupBy("image_id", "r", "c").agg(F.max_by(value, "ordinal").alias("v"))


def recrop(rois: DataFrame, pixels: DataFrame) -> DataFrame:
    """ROI pixels taken again from their (processed) parents.

    The range starts one past max(0, index - half the extract), as for fixed
    boxes.  An ROI whose parent is missing keeps a row with null pixels.
    """
    start = lambda index, n: F.greatest(F.lit(0), F.col(index) - F.floor(F.col(n) / 2).cast("int")) + 1
    spans = rois.withColumns({"row1": start("index_row", "extract_height"), "col1": start("index_col", "extract_width")})
    spans = spans.withColumn("r", F.explode(F.sequence(F.col("row1"), F.col("row1") + F.col("extract_height") - 1)))
    joined = spans.join(pixels.withColumnRenamed("image_id", "parent_image_id"), ["parent_image_id", "r"], "left")
    joined = joined.where(F.col("c").isNull() | ((F.col("c") >= F.col("col1")) & (F.col("c") < F.col("col1") + F.col("extract_width"))))
    return joined.withColumns({"wr": F.col("r") - F.col("row1"), "wc": F.col("c") - F.col("col1")})
