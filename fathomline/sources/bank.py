"""The reference bank as a table: build, append, upsert, read, describe."""

from __future__ import annotations

import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.exprs import as_doubles, norm
from fathomline.operators.search import check_dimension
from fathomline.sources.references import normalize_references, read_references
from fathomline.staging import Scratch, in_ranges


def build_bank(references: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Normalised references with ``embedding`` (by the injected encoder) and its ``norm``."""
    return with_norm(encode(references))


def with_norm(bank: DataFrame) -> DataFrame:
    return bank.withColumn("norm", norm(as_doubles(F.col("embedding"))))


def save_bank(bank: DataFrame, path: str) -> None:
    """Write by modality; modalities that are not in ``bank`` stay as they are."""
    bank.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("modality").parquet(path)


def append_bank(bank: DataFrame, path: str, dim: int) -> None:
    """Add rows; vectors of another dimension fail the job. Equal ids are kept."""
    check_dimension(bank, dim).write.mode("append").partitionBy("modality").parquet(path)


def load_bank(spark: SparkSession, path: str, modality: str | None = None) -> DataFrame:
    """The bank, or one modality of it (a partition, so nothing else is read)."""
    bank = spark.read.parquet(path)
    return bank.where(F.col("modality") == modality) if modality else bank


def default_ids(rows: DataFrame, base: int, order: str) -> DataFrame:
    """``ref_<n>`` for rows without an id, counted from the size of the collection.

    Only the rows without an id are numbered, range by range, with the sizes of the
    ranges before added; the others are not moved.
    """
    lacking = in_ranges(rows.where(F.col("id").isNull()), [F.col(order)], Scratch(rows.sparkSession, "ids"))
    sizes = lacking.groupBy("_slice").count()
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    n = F.row_number().over(Window.partitionBy("_slice").orderBy(order)) - 1 + F.col("_before") + F.lit(base)
    made = lacking.join(F.broadcast(offsets), "_slice").withColumn("id", F.concat(F.lit("ref_"), n))
    return rows.where(F.col("id").isNotNull()).unionByName(made.select(*rows.columns))


def upsert(stored: DataFrame, fresh: DataFrame, version: str) -> DataFrame:
    """Both tables with one row per id, that of the largest ``version``; a map-side combined aggregate, no sort of the bank."""
    both = stored.unionByName(fresh)
    rest = [c for c in both.columns if c != "id"]
    return both.groupBy("id").agg(F.max_by(F.struct(*rest), version).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def bank_from_file(spark: SparkSession, references: str, path: str, encode: Callable[[DataFrame], DataFrame], onto: bool = True) -> DataFrame:
    """References of a JSON file, normalised and encoded, saved as a bank; returns the saved bank.

    With ``onto`` rows that are there already stay unless the file has their id; else the modalities of
    the file are replaced. Of equal ids in one file the later text and path count.
    """
    fresh = build_bank(normalize_references(read_references(spark, references)), encode).withColumn("_version", F.lit(1))
    fresh = fresh.groupBy("id").agg(F.max(F.struct(*[c for c in fresh.columns if c not in ("id", "embedding", "norm")], "embedding", "norm")).alias("r")).select("id", "r.*")
    if onto and has_bank(spark, path):
        fresh = Scratch(spark, "bank").save(upsert(load_bank(spark, path).withColumn("_version", F.lit(0)).select(*fresh.columns), fresh, "_version"))
    save_bank(fresh.drop("_version"), path)
    return load_bank(spark, path)


def has_bank(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def load_indices(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(text, image) halves of a saved bank, None for a half without rows; a missing folder is an error."""
    if not has_bank(spark, path):
        raise FileNotFoundError(f"no bank at {path}")
    halves = {m: load_bank(spark, path, m) for m in ("text", "image")}
    return tuple(half if half.take(1) else None for half in halves.values())


def manifest(bank: DataFrame) -> DataFrame:
    """``(count, dim)`` of the bank."""
    return bank.agg(F.count("*").alias("count"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"))


def import_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """A bank stored as ``vectors.npy``, ``metadata.jsonl`` and ``manifest.json``.

    Blank metadata lines are skipped; the manifest's dimension wins. One array file
    is one task's work, as the format has no splits.
    """
    import numpy as np

    parts = spark.read.format("binaryFile").load([f"{folder}/vectors.npy", f"{folder}/metadata.jsonl", f"{folder}/manifest.json"])

    def rows(batches):
        import pandas as pd

        files = {p.rsplit("/", 1)[-1]: bytes(c) for batch in batches for p, c in zip(batch["path"], batch["content"], strict=True)}
        if files:
            vectors = np.load(io.BytesIO(files["vectors.npy"])).astype("float32")
            about = json.loads(files["manifest.json"]) if "manifest.json" in files else {}
            dim = int(about.get("dim") or (vectors.shape[1] if vectors.ndim > 1 else 0))
            meta = [json.loads(x) for x in files["metadata.jsonl"].decode().splitlines() if x.strip()]
            yield pd.DataFrame({"id": [m.get("id") for m in meta], "label": [m.get("label") for m in meta], "modality": [m.get("modality") for m in meta], "text": [m.get("text") for m in meta], "path": [m.get("path") for m in meta], "embedding": list(vectors.reshape(len(meta), dim))})

    return parts.select("path", "content").coalesce(1).mapInPandas(rows, "id string, label string, modality string, text string, path string, embedding array<float>")
