"""Summaries of evaluations as JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.plans.evaluate import mean_metrics


def benchmark_summary(metrics: DataFrame, mode: str, source: dict[str, str]) -> DataFrame:
    """One row ``(payload)``: number of labels, labels, mode, means, the metrics of each label and where they come from.

    ``metrics`` has one row per asked label, as ``label_metrics`` returns; labels come by name.
    """
    figures = F.struct(*[c for c in ("ap", "ar", "num_gt", "num_predictions", "reason") if c in metrics.columns])
    listed = metrics.agg(F.sort_array(F.collect_list(F.struct("label", figures.alias("m")))).alias("all"))
    about = F.struct(*[F.lit(v).alias(k) for k, v in source.items()])
    whole = listed.crossJoin(F.broadcast(mean_metrics(metrics)))  # one row beside one row
    return whole.select(F.to_json(F.struct("num_labels", F.transform("all", lambda x: x["label"]).alias("labels"), F.lit(mode).alias("mode"), "mean_ap", "mean_ar", F.map_from_entries("all").alias("metrics"), about.alias("source"))).alias("payload"))


def run_summary(pooled: DataFrame, predictions: DataFrame, truth: DataFrame, sample: DataFrame, times: DataFrame, iou: float = 0.5, seed: int = 42) -> DataFrame:
    """One row ``(payload)``: pooled AP and AR, counts, sample size and times of a run over sampled images.

    ``times(seconds)`` may be empty; then average time and rate are zero.
    """
    counts = [predictions.agg(F.count("*").alias("num_predictions")), truth.agg(F.count("*").alias("num_gt")), sample.agg(F.count("*").alias("sample_size")), times.agg(F.coalesce(F.avg("seconds") * 1000, F.lit(0.0)).alias("avg_time_ms"), F.coalesce(1 / F.avg("seconds"), F.lit(0.0)).alias("fps"))]
    whole = pooled.agg(F.coalesce(F.max("ap"), F.lit(0.0)).alias("ap"), F.coalesce(F.max("ar"), F.lit(0.0)).alias("ar"))
    for one in counts:  # aggregates of one row each
        whole = whole.crossJoin(F.broadcast(one))
    return whole.select(F.to_json(F.struct("sample_size", "num_predictions", "num_gt", "ap", "ar", "avg_time_ms", "fps", F.lit(iou).alias("iou_threshold"), F.lit(seed).alias("seed"))).alias("payload"))


def write_payloads(payloads: DataFrame, path: str) -> None:
    """The column ``payload`` as lines of JSON."""
    payloads.select("payload").write.mode("overwrite").text(path)
