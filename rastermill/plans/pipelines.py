"""The three whole flows: training windows to a classifier, images to a submission, predictions to scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from ..functions.store import Scratch
from ..operators import codec, evaluation, features, learning, markers, masks, segmentation, tiling
from ..operators import neighbourhood as nb
from ..operators.boxes import non_maximum_suppression
from ..operators.contrast import process_images
from ..operators.splitting import split_repeatedly

KEY = "image_id"


@dataclass(frozen=True)
class Options:
    """What a flow does at each step; the defaults are small."""

    size: tuple[int, int] = (16, 16)
    per_edge: int = 6
    step: tuple[int, int] = (3, 3)
    label_distance: int = 1
    image: dict = field(default_factory=dict)
    method: str = "pixelval"
    feature: dict = field(default_factory=dict)
    padding: str = "constant"
    suppression: float = 2.0
    holes: bool = True
    preprocess: str | None = None
    preprocess_sizes: tuple[int, int] = (1, 1)
    markers: str = "normal"
    factors: tuple[int, int, int] = (9, 5, 1)
    dilation: int = 3
    segmentation: str = "watershed"
    low: int = 0
    high_share: float = 1.0
    split_turns: int = 0
    split: dict = field(default_factory=dict)
    inside_mask: bool = True


def training_windows(pixels: DataFrame, images: DataFrame, mask: DataFrame, o: Options = Options()) -> DataFrame:
    """Rows (image_id, row_min, col_min, features, label) of labelled training windows."""
    ready = process_images(pixels, images, o.image)
    labelled = tiling.label_windows(tiling.training_windows(images, o.size, o.per_edge), mask, o.label_distance)
    boxes = labelled.select(KEY, F.col("row_min").alias("anchor_r"), F.col("col_min").alias("anchor_c"), F.col("extract_height").alias("window_h"), F.col("extract_width").alias("window_w"), learning.binary_target("is_positive").alias("label"))
    keys = [KEY, "anchor_r", "anchor_c", "label"]
    rows = features.window_features(tiling.window_pixels(boxes, ready), keys, *o.size, o.method, o.feature)
    return rows.withColumnsRenamed({"anchor_r": "row_min", "anchor_c": "col_min"})


def train(pixels: DataFrame, images: DataFrame, mask: DataFrame, estimator: Estimator, o: Options = Options()) -> Model:
    """A classifier of windows by whether a mask pixel is near their centres."""
    return learning.train(estimator, training_windows(pixels, images, mask, o))


def positive_windows(pixels: DataFrame, images: DataFrame, model: Model, o: Options = Options(), scratch: Scratch | None = None) -> DataFrame:
    """Sliding windows (image_id, ordinal, anchor_r, anchor_c, window_h, window_w, score) that the model takes for positive.

    Below 1, `suppression` is the overlap from which the better of two boxes
    stands for both.
    """
    half = (o.size[0] // 2, o.size[1] // 2)
    padded = tiling.pad_images(process_images(pixels, images, o.image), images, o.size, o.padding)
    boxes = tiling.inference_windows(images, o.size, o.step)
    inside = boxes.withColumns({"anchor_r": F.col("anchor_r") + half[0], "anchor_c": F.col("anchor_c") + half[1]})
    x = features.window_features(tiling.window_pixels(inside, padded), [KEY, "ordinal"], *o.size, o.method, o.feature)
    scored = learning.score(model, x).where("prediction > 0.5").select(KEY, "ordinal", "score")
    out = boxes.join(shuffled(scored), [KEY, "ordinal"])
    return non_maximum_suppression(out, o.suppression, scratch=scratch) if o.suppression < 1 else out


def foreground(boxes: DataFrame, images: DataFrame, o: Options = Options(), scratch: Scratch | None = None) -> DataFrame:
    """Mask (image_id, r, c) of the centres of boxes, without holes."""
    mask = tiling.boxes_to_mask(boxes, images)
    return segmentation.fill_holes(mask, images, scratch) if o.holes else mask


def smoothed(mask: DataFrame, images: DataFrame, kind: str | None, sizes: tuple[int, int]) -> DataFrame:
    """The mask after two steps of binary morphology, named in their order."""
    steps = {
        "closing_opening": (nb.closing, nb.opening), "dilation_erosion": (nb.dilate, nb.erode),
        "opening_closing": (nb.opening, nb.closing), "erosion_dilation": (nb.erode, nb.dilate),
    }
    if kind is None:
        return mask
    if kind not in steps:
        raise ValueError(f"unknown preprocessing: {kind}")
    for step, n in zip(steps[kind], sizes, strict=True):
        mask = step(mask, images, n)
    return mask


def segments(mask: DataFrame, images: DataFrame, o: Options = Options(), scratch: Scratch | None = None) -> DataFrame:
    """Segments (image_id, r, c, segment) of a mask, from markers and floods or from connection, within bounds of size."""
    scratch = scratch or Scratch(mask.sparkSession, "segments")
    mask = scratch.save(mask.select(KEY, "r", "c").distinct(), "mask")
    area = scratch.save(smoothed(mask, images, o.preprocess, o.preprocess_sizes), "area")
    if o.segmentation == "connected":
        out = segmentation.components(area, 8, scratch)
        if o.split_turns:
            out = split_repeatedly(out, o.split_turns, scratch=scratch, **o.split)
    elif o.segmentation == "watershed":
        if o.markers == "normal":
            seeds = segmentation.adaptive_markers(mask, images, o.factors, scratch=scratch)
        elif o.markers == "ultimate":
            seeds = segmentation.components(markers.ultimate_erosion(mask, images, o.dilation, scratch), 8, scratch)
        else:
            seeds = segmentation.components(mask, 8, scratch)
        levels = nb.squared_distances(mask, images).select(KEY, "r", "c", (-F.sqrt(F.coalesce("d2", F.lit(0)))).alias("v"))
        every = area.join(shuffled(levels), [KEY, "r", "c"], "left").select(KEY, "r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))
        out = segmentation.watershed(area, every, seeds, scratch)
    else:
        raise ValueError(f"unknown segmentation: {o.segmentation}")
    out = scratch.save(out, "segments")
    size = out.groupBy(KEY, "segment").agg(F.count("*").alias("size")).join(shuffled(images), KEY)
    kept = size.where((F.col("size") > o.low) & (F.col("size") < F.col("height") * F.col("width") * o.high_share)).select(KEY, "segment")
    out = out.join(shuffled(kept), [KEY, "segment"], "left_semi")
    return out.join(shuffled(mask), [KEY, "r", "c"], "left_semi").select(KEY, "r", "c", "segment") if o.inside_mask else out.select(KEY, "r", "c", "segment")


def submit(pixels: DataFrame, images: DataFrame, model: Model, height: int, o: Options = Options(), scratch: Scratch | None = None) -> DataFrame:
    """Rows (ImageId, segment, EncodedPixels), one for each segment of images of one height."""
    scratch = scratch or Scratch(pixels.sparkSession, "submission")
    mask = scratch.save(foreground(scratch.save(positive_windows(pixels, images, model, o, scratch), "windows"), images, o, scratch), "foreground")
    return codec.submission(segments(mask, images, o, scratch), height, mask="segment")


def evaluate(predicted: DataFrame, expected: DataFrame, thresholds: tuple[float, ...] = evaluation.THRESHOLDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores by image and threshold, totals by threshold, and the mean by image, from masks (image_id, mask_id, r, c)."""
    scores = evaluation.image_scores(predicted, expected, thresholds)
    return evaluation.with_precision(scores), evaluation.cumulative_scores(scores), evaluation.mean_score(scores, [KEY])


def region_windows(mask: DataFrame, pixels: DataFrame, height: int, width: int, keys: tuple[str, ...] = (KEY, "mask_id"), padding: int = 0, size: tuple[int, int] | None = None, square: bool = False) -> DataFrame:
    """Pixels of each mask's region of interest: its box grown by padding, of a fixed size about its centre, or squared."""
    if (padding > 0) + (size is not None) + square > 1:
        raise ValueError("padding, a fixed size and squares exclude one another")
    boxes = masks.bounding_boxes(mask, list(keys))
    if size is not None:
        boxes = masks.fixed_boxes(masks.with_centers(boxes), size, height, width)
        boxes = boxes.where((F.col("row_max") - F.col("row_min") == size[0]) & (F.col("col_max") - F.col("col_min") == size[1]))
    elif square:
        boxes = masks.square_boxes(boxes, height, width)
    elif padding:
        boxes = masks.padded_boxes(boxes, padding, height, width)
    return masks.crop(pixels, boxes)
