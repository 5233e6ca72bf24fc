"""Evaluation of detections against ground truth: matching, precision-recall curve, AP and AR."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.exprs import EPS
from fathomline.operators.boxes import match_greedy
from fathomline.staging import Scratch, in_ranges

def pr_curve(matched: DataFrame, truth: DataFrame, label: str = "label", confidence: str = "conf", order: tuple[str, ...] = ("image_id", "seq")) -> DataFrame:
    """Running precision and recall of each label, best predictions first, with the envelope.

    Rows are cut into ranges of the whole order (label, confidence, then ``order``),
    so neither a label nor a confidence that many rows share lands in one task. Sums
    run within a range; totals of the ranges (one row for each label in a range) are run on their own and
    added, and so is the envelope's maximum. That runs from the last row backwards: a
    window that ends at the last row is computed anew for each row, in the square of the range.
    """
    scratch = Scratch(matched.sparkSession, "curve")
    matched = scratch.save(matched)  # finding the ranges reads it once more
    total = scratch.save(truth.groupBy(label).agg(F.count("*").alias("num_gt")))
    keys = [label, "_slice"]
    rows = in_ranges(matched, [F.col(label), F.desc(confidence), *map(F.col, order)], scratch)
    slices = rows.groupBy(*keys).agg(F.sum("tp").alias("_tp"), F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(*keys, F.coalesce(F.sum("_tp").over(before), F.lit(0)).alias("_tp0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    by = Window.partitionBy(*keys).orderBy(F.desc(confidence), *order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumns({"_r": F.row_number().over(by), "_t": F.sum("tp").over(upto)}).join(offsets, keys).join(total, label, "left")
    run = run.withColumns({"num_gt": F.coalesce("num_gt", F.lit(0)), "n": F.col("_n0") + F.col("_r"), "tps": F.col("_tp0") + F.col("_t")})
    run = run.withColumns({"precision": F.col("tps") / (F.col("n") + F.lit(EPS)), "recall": F.col("tps") / (F.col("num_gt") + F.lit(EPS))})
    run = scratch.save(run.withColumn("step", F.col("recall") - (F.col("tps") - F.col("tp")) / (F.col("num_gt") + F.lit(EPS))))
    after = Window.partitionBy(label).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    later = run.groupBy(*keys).agg(F.max("precision").alias("_p")).select(*keys, F.max("_p").over(after).alias("_later"))
    rest = Window.partitionBy(*keys).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = run.withColumn("_own", F.max("precision").over(rest)).join(later, keys)
    return curve.withColumn("envelope", F.greatest("_own", "_later")).drop("_slice", "_tp0", "_n0", "_r", "_t", "_own", "_later")


def average_precision(matched: DataFrame, truth: DataFrame, label: str = "label", **how: object) -> DataFrame:
    """``(label, ap, ar, num_gt, num_predictions)`` of every label that is predicted or true."""
    curve = pr_curve(matched, truth, label, **how)
    scored = curve.groupBy(label).agg(F.sum(F.when(F.col("num_gt") > 0, F.col("step") * F.col("envelope")).otherwise(0.0)).alias("ap"), F.max(F.when(F.col("num_gt") > 0, F.col("recall")).otherwise(0.0)).alias("ar"), F.count("*").alias("num_predictions"))
    total = truth.groupBy(label).agg(F.count("*").alias("num_gt"))
    out = scored.join(total, label, "full")
    return out.select(label, F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("ar", F.lit(0.0)).alias("ar"), F.coalesce("num_gt", F.lit(0)).alias("num_gt"), F.coalesce("num_predictions", F.lit(0)).alias("num_predictions"))


def label_metrics(labels: DataFrame, scored: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per asked label; labels that no category has get zeros and a reason."""
    known = truth.select("label").distinct().withColumn("_known", F.lit(True))
    rows = labels.join(known, "label", "left").join(scored, "label", "left")
    lacking = F.col("_known").isNull()
    zero = {c: F.when(lacking, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c in ("ap", "ar", "num_gt", "num_predictions")}
    return rows.select("label", *zero.values(), F.when(lacking, F.lit("category_not_in_coco")).alias("reason"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """``(mean_ap, mean_ar, num_labels)``: unweighted means, zero without labels."""
    return metrics.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("mean_ap"), F.coalesce(F.avg("ar"), F.lit(0.0)).alias("mean_ar"), F.count("*").alias("num_labels"))


def pooled_average_precision(matched: DataFrame, truth: DataFrame, **how: object) -> DataFrame:
    """One AP and AR over all labels together: the same sliced curve with a single label."""
    one = F.lit("all")
    return average_precision(matched.withColumn("_pool", one), truth.withColumn("_pool", one), "_pool", **how).select("ap", "ar")


def evaluate(predictions: DataFrame, truth: DataFrame, labels: DataFrame, iou: float = 0.5, present: DataFrame | None = None) -> DataFrame:
    """Metrics of each asked label, from predictions and true boxes (``image_id, label`` and corners).

    ``present(image_id)`` lists the images that could be read: predictions in others are
    left out, their true boxes count all the same.
    """
    own = predictions if present is None else predictions.join(present.select("image_id").distinct(), "image_id", "left_semi")
    matched = match_greedy(own, truth, ["image_id", "label"], iou)
    return label_metrics(labels, average_precision(matched, truth), truth)


def timing(times: DataFrame, column: str = "seconds") -> DataFrame:
    """``(avg_time_ms, fps)`` of a table of durations."""
    return times.agg((F.avg(column) * 1000).alias("avg_time_ms"), (1 / F.avg(column)).alias("fps"))
