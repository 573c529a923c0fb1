"""Matching of predicted and expected masks, threshold scores, and classification reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinals import running_sums

#: The scoring thresholds, with their float noise.
THRESHOLDS = (0.5, 0.55, 0.6000000000000001, 0.6500000000000001, 0.7000000000000002, 0.7500000000000002, 0.8000000000000003, 0.8500000000000003, 0.9000000000000004, 0.9500000000000004)


def best_matches(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (image_id, pred_id, exp_id, iou) from (image_id, mask_id, r, c) on both sides.

    The match has the most pixels in common, ties to the smaller id; iou is 0
    and exp_id null without any.  Several predictions may match one mask.
    Pairs meet on shared pixels only.
    """
    p, e = predicted.withColumnRenamed("mask_id", "pred_id"), expected.withColumnRenamed("mask_id", "exp_id")
    common = p.join(e, ["image_id", "r", "c"]).groupBy("image_id", "pred_id", "exp_id").agg(F.count("*").alias("both"))
    best = common.groupBy("image_id", "pred_id").agg(F.min(F.struct((-F.col("both")).alias("k"), "exp_id")).alias("best"))
    p_size, e_size = p.groupBy("image_id", "pred_id").agg(F.count("*").alias("n_p")), e.groupBy("image_id", "exp_id").agg(F.count("*").alias("n_e"))
    out = p_size.join(best, ["image_id", "pred_id"], "left").select("image_id", "pred_id", "n_p", F.col("best.exp_id").alias("exp_id"), (-F.col("best.k")).alias("both"))
    out = out.join(e_size, ["image_id", "exp_id"], "left")
    return out.select("image_id", "pred_id", "exp_id", F.coalesce(F.col("both") / (F.col("n_p") + F.col("n_e") - F.col("both")), F.lit(0.0)).alias("iou"))


def image_scores(predicted: DataFrame, expected: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Rows (image_id, threshold, tp, fp, fn): counts of matches strictly above each threshold."""
    matches = best_matches(predicted, expected)
    n_expected = expected.select("image_id", "mask_id").distinct().groupBy("image_id").agg(F.count("*").alias("n_exp"))
    at = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    found = matches.select("image_id", "iou", at).groupBy("image_id", "threshold").agg(F.count("*").alias("n_pred"), F.sum((F.col("iou") > F.col("threshold")).cast("long")).alias("tp"))
    out = n_expected.select("image_id", "n_exp", at).join(found, ["image_id", "threshold"], "full").fillna(0, ["n_exp", "n_pred", "tp"])
    return out.select("image_id", "threshold", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_exp") - F.col("tp")).alias("fn"))


def with_precision(scores: DataFrame) -> DataFrame:
    """tp / (tp + fp + fn); null where all are 0."""
    total = F.col("tp") + F.col("fp") + F.col("fn")
    return scores.withColumn("precision", F.when(total != 0, F.col("tp") / total))


def cumulative_scores(scores: DataFrame) -> DataFrame:
    """Totals over images by threshold, with their precision."""
    return with_precision(scores.groupBy("threshold").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")]))


def running_scores(scores: DataFrame) -> DataFrame:
    """Totals up to and including each image, in order of image_id."""
    return with_precision(running_sums(scores, ["threshold"], "image_id", ["tp", "fp", "fn"]))


def mean_score(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean precision over thresholds."""
    return with_precision(scores).groupBy(*keys).agg(F.avg("precision").alias("score"))


def score_table(scores: DataFrame) -> DataFrame:
    """Text lines of a score table, in order of threshold."""
    line = F.format_string("%.3f\t%d\t%d\t%d\t%.3f", "threshold", "tp", "fp", "fn", "precision")
    return with_precision(scores).select("threshold", line.alias("line"))


def confusion_matrix(rows: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(rows: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Rows (class, precision, recall, f1, support); a score without cases is 0."""
    cells = confusion_matrix(rows, expected, predicted)
    by = cells.select(F.explode(F.array(F.struct(F.col("expected").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")))).alias("x"), (F.col("expected") == F.col("predicted")).alias("hit"))
    sums = by.groupBy("x.class").agg(F.sum("x.support").alias("support"), F.sum("x.called").alias("called"), F.sum(F.when(F.col("hit"), F.col("x.support")).otherwise(0)).alias("tp"))
    p, r = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = sums.select("class", p.alias("precision"), r.alias("recall"), "support")
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def weighted_report(report: DataFrame) -> DataFrame:
    """One row of averages weighted by support."""
    return report.agg(*[(F.sum(F.col(k) * F.col("support")) / F.sum("support")).alias(k) for k in ("precision", "recall", "f1")], F.sum("support").alias("support"))


def predictions(rows: DataFrame, correct: bool, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """The rows predicted correctly, or those that aren't."""
    same = F.col(expected).eqNullSafe(F.col(predicted))
    return rows.where(same if correct else ~same)
