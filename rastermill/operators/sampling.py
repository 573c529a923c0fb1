"""Splits, subsets, negatives and batches, drawn by hash so that reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masks import bounding_boxes, with_centers
from .ordinals import numbered, numbered_by


def draw(*columns: str, seed: int) -> Column:
    """A random order of rows: md5 of their key and the seed."""
    return F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def split_by_ratio(ids: DataFrame, key: str, names: list[str], ratios: list[float], seed: int = 100) -> DataFrame:
    """Rows (key, split): floor(n * ratio) ids each, in random order; what is left over is dropped."""
    if len(names) != len(ratios):
        raise ValueError("as many names as ratios are needed")
    n = ids.count()
    rows = numbered(ids.select(key), [draw(key, seed=seed), key])
    split, end = None, 0
    for name, ratio in zip(names, ratios, strict=True):
        start, end = end, end + int(n * ratio)
        hit = F.col("nth").between(start + 1, end)
        split = F.when(hit, name) if split is None else split.when(hit, name)
    return rows.select(key, split.alias("split")).where("split is not null")


def stratified_subset(rows: DataFrame, key: str, fraction: float, strata: list[str] | None = None, seed: int = 1) -> DataFrame:
    """round(fraction * n) rows of each stratum, in random order; one stratum without strata."""
    ranked = numbered_by(rows, strata or [], [draw(key, seed=seed), key], "_nth", "_n")
    return ranked.where(F.col("_nth") <= F.floor(F.col("_n") * fraction + 0.5)).drop("_nth", "_n")


def negatives(images: DataFrame, centers: DataFrame, size: tuple[int, int], k: int, buffer: int = 0, seed: int = 100) -> DataFrame:
    """k random centres of each image whose box fits and that are farther than buffer (L1) from all centres (image_id, r, c)."""
    return ranked_negatives(images, centers, size, buffer, seed).where(F.col("nth") <= k).drop("nth")


def ranked_negatives(images: DataFrame, centers: DataFrame, size: tuple[int, int], buffer: int = 0, seed: int = 100) -> DataFrame:
    """All admissible centres (image_id, center_r, center_c) with their place nth in a random order of their image's.

    No admissible centre gives no row.  Forbidden places are listed around each
    centre and excluded by equality.
    """
    before = (size[0] // 2 - 1, size[1] // 2 - 1)
    inside = images.select("image_id", F.explode(F.sequence(F.lit(before[0]), F.col("height") - (size[0] - before[0]))).alias("r"), "width")
    inside = inside.select("image_id", "r", F.explode(F.sequence(F.lit(before[1]), F.col("width") - (size[1] - before[1]))).alias("c"))
    around = [(a, b) for a in range(-buffer, buffer + 1) for b in range(abs(a) - buffer, buffer - abs(a) + 1)]
    near = centers.select("image_id", "r", "c", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in around])).alias("o"))
    near = near.select("image_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()
    free = inside.join(near, ["image_id", "r", "c"], "left_anti")
    order = Window.partitionBy("image_id").orderBy(draw("image_id", "r", "c", seed=seed), "r", "c")
    return free.select("image_id", F.col("r").alias("center_r"), F.col("c").alias("center_c"), F.row_number().over(order).alias("nth"))


def roi_batch(masks: DataFrame, images: DataFrame, size: tuple[int, int], per_mask: int, buffer: int = 0, seed: int = 100) -> DataFrame:
    """One table of regions for training: a positive for each mask (image_id, mask_id, r, c), and per_mask negatives for each.

    Rows (filename, parent_image_id, extract_height, extract_width,
    image_height, image_width, index_row, index_col, is_positive).  Positives
    are centred on their mask's box; negatives of an image are drawn without
    replacement among the admissible centres, numbered with five digits, and
    fewer where there aren't as many.
    """
    boxes = with_centers(bounding_boxes(masks, ["image_id", "mask_id"]))
    name = lambda kind, *parts: F.concat_ws("_", F.lit(kind), *[p.cast("string") for p in parts])
    positive = boxes.select("image_id", name("pos", F.col("image_id"), F.col("mask_id")).alias("filename"), "center_r", "center_c", F.lit("1").alias("is_positive"))
    centers = boxes.select("image_id", F.col("center_r").alias("r"), F.col("center_c").alias("c"))
    wanted = boxes.groupBy("image_id").agg((F.count("*") * per_mask).alias("wanted"))
    drawn = ranked_negatives(images, centers, size, buffer, seed).join(wanted, "image_id").where("nth <= wanted")
    number = F.lpad(F.col("nth").cast("string"), 5, "0")
    negative = drawn.select("image_id", name("neg", F.col("image_id"), number).alias("filename"), "center_r", "center_c", F.lit("0").alias("is_positive"))
    rows = positive.unionByName(negative).join(images, "image_id")
    return rows.select(
        "filename", F.col("image_id").alias("parent_image_id"), F.lit(size[0]).alias("extract_height"), F.lit(size[1]).alias("extract_width"), F.col("height").alias("image_height"), F.col("width").alias("image_width"),
        F.col("center_r").alias("index_row"), F.col("center_c").alias("index_col"), "is_positive",
    )


def endless_batches(rows: DataFrame, key: str, size: int, batches: int, seed: int = 1) -> DataFrame:
    """`batches` batches of `size` rows drawn with replacement: rows with their batch and place in it; reruns agree.

    Each draw names a row by its place in order of key, so any stretch of an
    endless sequence of batches can be made alone.  No rows give no batches.
    """
    n = rows.count()
    if not n:
        return rows.withColumns({"batch": F.lit(0).cast("long"), "place": F.lit(0).cast("long")})
    draws = rows.sparkSession.range(batches * size).select(F.expr(f"id div {size}").alias("batch"), (F.col("id") % size).alias("place"), (F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("long"), F.lit(n)) + 1).alias("_nth"))
    return numbered(rows, [key], "_nth").join(draws, "_nth").drop("_nth")


def oversample(rows: DataFrame, times: int) -> DataFrame:
    """Each row `times` times, numbered by copy."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def mini_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with the ordinal of their batch, in order of key."""
    return numbered(rows, [key], "_nth").withColumn("batch", F.floor((F.col("_nth") - 1) / size).cast("int")).drop("_nth")


def first_wins(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All preferred rows, and those of other whose key they lack."""
    return preferred.unionByName(other.join(preferred.select(key), key, "left_anti").select(*preferred.columns))


def augment(pixels: DataFrame, images: DataFrame, seed: int = 1) -> DataFrame:
    """Each image turned by 0, 90, 180 or 270 degrees or flipped about either axis, by hash of its id."""
    sized = pixels.join(images, "image_id")
    way = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.col("image_id").cast("string"), F.lit(str(seed)))), 1, 4), 16, 10).cast("int"), F.lit(6))
    sized = sized.withColumn("way", way)
    h, w, r, c = F.col("height") - 1, F.col("width") - 1, F.col("r"), F.col("c")
    row = F.when(F.col("way") == 1, c).when(F.col("way") == 2, h - r).when(F.col("way") == 3, w - c).when(F.col("way") == 4, h - r).otherwise(r)
    col = F.when(F.col("way") == 1, h - r).when(F.col("way") == 2, w - c).when(F.col("way") == 3, r).when(F.col("way") == 5, w - c).otherwise(c)
    return sized.select("image_id", "way", row.alias("r"), col.alias("c"), "v")


def hold_out(rows: DataFrame, key: str, share: float | int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The rows less a random share (or number) of them, and those; rows are dealt by hash of their key."""
    n = share if isinstance(share, int) else int(rows.count() * share)
    ranked = numbered(rows.select(key), [draw(key, seed=seed), key], "_nth").where(F.col("_nth") <= n).select(key)
    return rows.join(ranked, key, "left_anti"), rows.join(ranked, key, "left_semi")


def pick(rows: DataFrame, key: str, n: int = 1, seed: int = 1) -> DataFrame:
    """n rows at random; reruns agree."""
    return rows.orderBy(draw(key, seed=seed), key).limit(n)


def with_replacement(rows: DataFrame, times: float, seed: int = 1) -> DataFrame:
    """About `times` as many rows, each drawn with replacement."""
    return rows.sample(withReplacement=True, fraction=times, seed=seed)


def nth_in_order(rows: DataFrame, key: str, first: int = 1, last: int | None = None) -> DataFrame:
    """Rows whose place in order of key, from 1, is first to last: to start again at one, or take just one."""
    ranked = numbered(rows, [key], "_nth")
    kept = ranked.where(F.col("_nth") >= first if last is None else F.col("_nth").between(first, last))
    return kept.drop("_nth")


def first_existing(names: DataFrame, key: str, *choices: DataFrame) -> DataFrame:
    """Each name with `path` from the first of choices (key, path) that has it; the name itself if none has."""
    out = names
    for k, c in enumerate(choices):
        out = out.join(c.select(key, F.col("path").alias(f"_path{k}")), key, "left")
    found = F.coalesce(*[F.col(f"_path{k}") for k in range(len(choices))], F.col(key).cast("string"))
    return out.withColumn("path", found).drop(*[f"_path{k}" for k in range(len(choices))])
