"""A corpus pipeline of five operators: language, repeated lines, near copies, benchmark leaks, token ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.arrow import shrink_workers
from fathomline.llm.bpe import round_trip
from fathomline.llm.decontaminate import drop_contaminated
from fathomline.llm.langid import UNKNOWN, fit_filters, identify
from fathomline.llm.linededup import dedup_lines
from fathomline.llm.scratch import Scratch
from fathomline.llm.simhash import drop_near_copies
from fathomline.staging import shrink_executors

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this score a text has too few n-grams of any known language.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` becomes the language found."""
    found = identify(docs, fit_filters(docs), keep=("text", "source", "n_chars"))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut out; documents of which nothing is left go."""
    cut = dedup_lines(docs.select(COLUMNS))
    kept = cut.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id; unlike texts stay whatever their ids."""
    return drop_near_copies(docs.select(COLUMNS))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return drop_contaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def afresh(stage: Stage) -> Stage:
    """The stage, begun after executors and their Python workers have given back what earlier ones made them take."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_workers(spark)
        shrink_executors(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [(stage.__name__, afresh(stage)) for stage in (language, lines, near_copies, leaks, token_ids)]

#: SQL can express neither the trained filters nor the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
