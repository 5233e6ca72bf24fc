"""Order-dependent operators on boxes, as folds over sorted arrays: suppression and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.exprs import box, iou

BOX = "x1 double, y1 double, x2 double, y2 double"


def _row(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])


def nms(boxes: DataFrame, scope: list[str], threshold: float = 0.5, score: str = "confidence", order: str = "seq", least: float | None = None) -> DataFrame:
    """Rows that survive greedy suppression: by falling score, a box goes when it overlaps a kept one by more than ``threshold``.

    ``scope`` are the columns within which boxes see each other (image, label and,
    if wanted, query). With ``least`` boxes below it are dropped first: they could
    only be suppressed by better ones, never suppress those, so the rest is the same.
    Only the columns that the fold needs enter it; the others are joined back.
    """
    own = boxes.where(F.col(score) >= least) if least is not None else boxes
    items = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"), "x1", "y1", "x2", "y2")))
    fold = F.aggregate("items", F.slice("items", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: iou(box(k), box(x)) > threshold), kept).otherwise(F.concat(kept, F.array(x))))
    alone = own.groupBy(*scope).agg(items.alias("items")).select(*scope, F.explode(fold).alias("k")).select(*scope, F.col("k.o").alias(order))
    return own.join(alone, [*scope, order], "left_semi")


def match_greedy(predictions: DataFrame, truth: DataFrame, scope: list[str], threshold: float = 0.5, confidence: str = "conf", order: str = "seq", truth_order: str = "gt_seq") -> DataFrame:
    """``(scope, order, confidence, tp)``: each prediction takes the free true box that it overlaps most.

    In order of falling confidence (ties: ``order``), within ``scope`` (image and
    label); the first of equal overlaps wins; a hit needs ``threshold`` or more.
    """
    p = predictions.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct((-F.col(confidence)).alias("c"), F.col(order).alias("o"), "x1", "y1", "x2", "y2"))).alias("ps"))
    g = truth.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct(F.col(truth_order).alias("o"), "x1", "y1", "x2", "y2"))).alias("gs"))
    kind = p.schema["ps"].dataType.elementType
    out_type = f"array<struct<o:{kind['o'].dataType.simpleString()},c:{kind['c'].dataType.simpleString()},tp:int>>"
    gt_type = truth.schema[truth_order].dataType.simpleString()
    best_type = f"struct<i:double,o:{gt_type}>"
    start = F.struct(F.array().cast(f"array<{gt_type}>").alias("used"), F.array().cast(out_type).alias("out"))

    def take(state: Column, x: Column) -> Column:
        free = F.filter("gs", lambda t: ~F.array_contains(state["used"], t["o"]))
        overlaps = F.transform(free, lambda t: F.struct(iou(box(t), box(x)).alias("i"), t["o"].alias("o")))
        best = F.aggregate(overlaps, F.struct(F.lit(0.0).alias("i"), F.lit(None).cast(gt_type).alias("o")).cast(best_type), lambda b, t: F.when(t["i"] > b["i"], t).otherwise(b))

        def settle(b: Column) -> Column:
            hit = b["o"].isNotNull() & (b["i"] >= threshold)
            row = F.struct(x["o"].alias("o"), x["c"].alias("c"), hit.cast("int").alias("tp"))
            return F.struct(F.when(hit, F.concat(state["used"], F.array(b["o"]))).otherwise(state["used"]).alias("used"), F.concat(state["out"], F.array(row)).alias("out"))

        return F.transform(F.array(best), settle)[0]

    joined = p.join(g, scope, "left").withColumn("gs", F.coalesce("gs", F.array().cast(g.schema["gs"].dataType)))
    rows = joined.select(*scope, F.explode(F.aggregate("ps", start, take, lambda s: s["out"])).alias("r"))
    return rows.select(*scope, F.col("r.o").alias(order), (-F.col("r.c")).alias(confidence), F.col("r.tp").alias("tp"))


def cap_proposals(proposals: DataFrame, most: int, image: str = "image_id", order: str = "seq") -> DataFrame:
    """The first ``most`` proposals of each image in the model's order; at least one."""
    n = F.row_number().over(Window.partitionBy(image).orderBy(order))
    return proposals.withColumn("_n", n).where(F.col("_n") <= max(1, most)).drop("_n")
