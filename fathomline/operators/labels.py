"""Labels that a query stands for, and what each label's evidence is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.config import BOOSTS, EngineConfig


def best_by_label(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """``(key, label, best)``: each label's largest similarity to the query."""
    return hits.where(F.trim("label") != "").groupBy(key, F.trim("label").alias("label")).agg(F.max("score").alias("best"))


def resolve_labels(hits: DataFrame, queries: DataFrame, config: EngineConfig, key: str = "query_id", name: str = "query_label") -> DataFrame:
    """``(key, label)``: labels named like the query or similar enough to it; the query itself where none is.

    ``queries(key, name)``; blank names give no label at all.
    """
    asked = queries.select(key, F.trim(name).alias("_q")).where("_q <> ''").distinct()
    best = best_by_label(hits, key).join(asked, key)
    top = F.max("best").over(Window.partitionBy(key))
    keep = (F.lower("label") == F.lower("_q")) | (F.col("best") >= F.greatest(F.lit(config.evidence.label_floor), F.lit(config.evidence.label_ratio) * top))
    kept = best.withColumn("_keep", keep).where("_keep").select(key, "label")
    missing = asked.join(kept.select(key).distinct(), key, "left_anti").select(key, F.col("_q").alias("label"))
    return kept.unionByName(missing)


def query_boost(hits: DataFrame, labels: DataFrame, key: str = "query_id") -> DataFrame:
    """``(key, label, boost)``: the best similarity of each label that the query stands for."""
    return best_by_label(hits, key).join(labels, [key, "label"]).withColumnRenamed("best", "boost")


def image_boost(hits: DataFrame, how: str = "mean", call: str | None = None) -> DataFrame:
    """``(call, label, boost)`` pooled over the hits of all query images of a call.

    ``mean`` and ``max`` of the similarities; ``mode`` keeps the one label with the
    most hits (ties: larger mean, then name) and its boost is that count.
    """
    how = (how or "mean").strip().lower()
    if how not in BOOSTS:
        raise ValueError(f"the boost must be one of {BOOSTS}")
    keys = [call] if call else []
    pooled = hits.where(F.trim("label") != "").groupBy(*keys, "label").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.max("score").alias("best"))
    if how != "mode":
        return pooled.select(*keys, "label", F.col("mean" if how == "mean" else "best").alias("boost"))
    top = F.min(F.struct((-F.col("n")).alias("n"), (-F.round("mean", 9)).alias("mean"), "label")).alias("top")
    return pooled.groupBy(*keys).agg(top).where("top is not null").select(*keys, F.col("top.label").alias("label"), (-F.col("top.n")).cast("double").alias("boost"))
