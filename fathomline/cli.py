"""Command line: index references, detect in encoded regions, draw captions, evaluate predictions.

Tables are Parquet; encoders are named as ``module:function`` and are called without arguments.
"""

from __future__ import annotations

import argparse
import importlib
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.config import EngineConfig
from fathomline.functions.encoders import encode_column, hashed_words
from fathomline.functions.exprs import overlay_label
from fathomline.plans.detect import Engine, detections_json
from fathomline.plans.evaluate import evaluate
from fathomline.plans.report import benchmark_summary, write_payloads
from fathomline.sources.bank import bank_from_file, load_bank
from fathomline.sources.references import read_coco, read_prompts


def asked_queries(listed: str | None, single: list[str] | None) -> list[str]:
    """Queries of a comma-separated list, trimmed and without blanks, then those given one by one."""
    return [x.strip() for x in (listed or "").split(",") if x.strip()] + [x for x in single or [] if x.strip()]


def metadata_filter(text: str | None) -> dict[str, object] | None:
    """The attributes of a JSON object; anything else is an error."""
    wanted = json.loads(text) if text else None
    if wanted is not None and not isinstance(wanted, dict):
        raise ValueError("the metadata filter must be a JSON object")
    return wanted


def _encoder(name: str | None):
    if not name:
        return hashed_words()
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def index(spark: SparkSession, args: argparse.Namespace) -> None:
    make = _encoder(args.encoder)
    bank_from_file(spark, args.references, args.bank, lambda refs: encode_column(refs.withColumn("_of", F.coalesce("text", "path")), "_of", make).drop("_of"), onto=not args.replace)


def detect(spark: SparkSession, args: argparse.Namespace) -> None:
    config = EngineConfig()
    config = replace(config, retrieval=replace(config.retrieval, top_k=args.top_k), suppression=replace(config.suppression, least=args.score_threshold, overlap=args.nms_iou))
    engine, regions, wanted = Engine(load_bank(spark, args.bank), config), spark.read.parquet(args.regions), metadata_filter(args.metadata_filter)
    texts = asked_queries(args.queries, args.query)
    found: list[DataFrame] = []
    if args.mode in ("text", "hybrid") and texts:
        rows = spark.createDataFrame(list(enumerate(texts)), "query_id long, query_label string")
        found.append(engine.detect_text(regions, encode_column(rows, "query_label", _encoder(args.encoder)), wanted).withColumn("source", F.lit("text_query")))
    if args.mode in ("image", "hybrid") and args.query_images:
        found.append(engine.detect_image(regions, spark.read.parquet(args.query_images), args.query_image_agg, wanted).withColumn("source", F.lit("image_query")))
    if not found:
        raise ValueError(f"{args.mode} mode needs queries")
    whole = found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)
    write_payloads(detections_json(whole, config, facts={"queries": texts, "query_images": [args.query_images] if args.query_images else [], "query_image_agg": args.query_image_agg}), args.out)


def draw(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.read.parquet(args.predictions)
    zero = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("x1", "y1", "x2", "y2")]
    rows.select("image_id", *zero, overlay_label(F.col("label"), F.col("confidence"), F.col("score")).alias("caption")).write.mode("overwrite").parquet(args.out)


def benchmark(spark: SparkSession, args: argparse.Namespace) -> None:
    _, _, truth = read_coco(spark, args.annotations)
    predictions = spark.read.parquet(args.predictions)
    labels = read_prompts(spark, args.prompts).select("label").distinct() if args.prompts else truth.select("label").distinct()
    present = spark.read.parquet(args.images) if args.images else None
    metrics = evaluate(predictions, truth, labels, args.iou, present)
    write_payloads(benchmark_summary(metrics, args.mode, {"predictions": args.predictions, "prompts": args.prompts or ""}), args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fathomline")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *required: str) -> argparse.ArgumentParser:
        made = sub.add_parser(name)
        made.set_defaults(run=run)
        for option in required:
            made.add_argument(f"--{option}", required=True)
        return made

    made = command("index", index, "references", "bank")
    made.add_argument("--encoder")
    made.add_argument("--replace", action="store_true")
    made = command("detect", detect, "bank", "regions", "out")
    made.add_argument("--mode", choices=("text", "image", "hybrid"), default="text")
    for option in ("--queries", "--query-images", "--metadata-filter", "--encoder"):
        made.add_argument(option)
    made.add_argument("--query", action="append")
    made.add_argument("--query-image-agg", choices=("mean", "max", "mode"), default="mean")
    made.add_argument("--top-k", type=int, default=20)
    made.add_argument("--score-threshold", type=float, default=0.15)
    made.add_argument("--nms-iou", type=float, default=0.5)
    command("draw", draw, "predictions", "out")
    made = command("benchmark", benchmark, "annotations", "predictions", "out")
    made.add_argument("--prompts")
    made.add_argument("--images")
    made.add_argument("--mode", default="text")
    made.add_argument("--iou", type=float, default=0.5)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("fathomline").getOrCreate(), args)


if __name__ == "__main__":
    main()
