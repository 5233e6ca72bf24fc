"""Evidence of labels: aggregation, margin, consistency, support and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import AGGREGATIONS, EngineConfig
from fathomline.functions.exprs import EPS, confidence


def label_scores(hits: DataFrame, keys: list[str], config: EngineConfig, methods: tuple[str, ...] | None = None) -> DataFrame:
    """One row per key and label: aggregates of its best ``best`` hits and its spread.

    Columns ``agg`` (or ``agg_<method>`` for several), ``consistency`` (population
    deviation of all hits), ``support`` (share above the threshold), ``n`` and
    ``first_rank``, the best rank of a hit.
    """
    for m in methods or ():
        if m not in AGGREGATIONS:
            raise ValueError(f"aggregation must be one of {AGGREGATIONS}")
    by = Window.partitionBy(*keys, "label")
    ranked = hits.withColumn("_lrk", F.row_number().over(by.orderBy(F.desc("score"), F.asc("id")))).withColumn("_max", F.max("score").over(by))
    t = config.evidence.temperature if config.evidence.temperature > 0 else 1e-6
    s, inside = F.col("score"), F.col("_lrk") <= config.evidence.best
    e = F.exp((s - F.col("_max")) / t)
    made: dict[str, Column] = {
        "weighted_mean": F.sum(F.when(inside, e * s)) / (F.sum(F.when(inside, e)) + EPS),
        "max": F.max(F.when(inside, s)),
        "mean": F.avg(F.when(inside, s)),
        "lse": F.ln(F.sum(F.when(inside, F.exp(s))) + EPS),
    }
    chosen = [made[m].alias(f"agg_{m}") for m in methods] if methods else [made[config.evidence.method].alias("agg")]
    spread = [F.stddev_pop("score").alias("consistency"), F.avg((s > config.evidence.support_above).cast("double")).alias("support"), F.count("*").alias("n"), F.min("rank").alias("first_rank")]
    return ranked.groupBy(*keys, "label").agg(*chosen, *spread)


def add_boost(scores: DataFrame, boost: DataFrame, on: list[str], config: EngineConfig) -> DataFrame:
    """``agg`` raised by the weighted boost of its label, where there is one."""
    return scores.join(boost, on, "left").withColumn("agg", F.col("agg") + config.evidence.boost_weight * F.coalesce("boost", F.lit(0.0))).drop("boost")


def best_label(scores: DataFrame, keys: list[str], config: EngineConfig) -> DataFrame:
    """The best label of each key with its ``margin`` over the second (or over the guard)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("agg", 9)), F.asc("first_rank"))
    ranked = scores.withColumn("_n", F.row_number().over(order)).withColumn("margin", F.col("agg") - F.coalesce(F.lead("agg").over(order), F.lit(config.evidence.margin_guard)))
    return ranked.where("_n = 1").drop("_n", "first_rank")


def with_confidence(best: DataFrame, objectness: str = "objectness") -> DataFrame:
    return best.withColumn("confidence", confidence(F.col("agg"), F.col("margin"), F.col("consistency"), F.col(objectness), F.col("support")))
