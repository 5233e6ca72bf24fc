"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrow import text_chunks
from fathomline.shipping import ship

_SPAN = 1 << 30


def crc_rest(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")), F.lit(modulus))


def hash_sample(rows: DataFrame, key: str, by: str, per_value: int) -> DataFrame:
    """The rows of about ``per_value`` keys for each value of ``by``, those with the least hashes of ``key``.

    Keys are counted, not rows: a key with very many rows neither is more likely to
    be taken nor pushes others out. Where there are fewer keys, all are taken. One
    scan with an approximate count (of 2 %) per value, and nothing shuffled but the counts. The values
    are few by contract (languages, classes); their counts alone reach the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).agg(F.approx_count_distinct(key, 0.02)).collect()}
    keep = F.lit(False)
    spread = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit("sample")), F.lit(_SPAN))
    for value, n in counts.items():
        if value is not None and n:
            keep |= (F.col(f"`{by}`") == F.lit(value)) & (spread < F.lit(int(_SPAN * min(1.0, per_value / n))))
    return rows.where(keep)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """``(id, text, label, weight)`` of about ``per_class`` labelled ids of each class, one row each.

    Rows of the held-out remainder and rows without text or label teach nothing, nor
    does an id with both labels; an id with several texts teaches that with the
    least hash. ``weight`` restores the share of the classes. The chosen ids are about
    ``2 * per_class``, so they are broadcast; nothing depends on the order of rows.
    """
    given = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{doc_id}`").isNotNull() & (crc_rest(doc_id, modulus) != held_out)).select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = given.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label")
    picked = hash_sample(known, "id", "label", per_class)
    texts = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    weight = F.lit(1.0)
    for value, n in totals.items():
        weight = F.when(F.col("label") == value, F.lit(max(1.0, n / per_class))).otherwise(weight)
    return texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label")).select("id", "text", "label", weight.alias("weight"))


def fit_in_one_task(rows: DataFrame, fit: Callable[[Iterator[tuple[list[str], np.ndarray, np.ndarray]]], object]) -> object | None:
    """Run ``fit`` over chunks (texts, labels, weights) of a bounded sample in one executor task.

    The texts never reach the driver; the fitted object comes back as one pickled
    row. Rows come in the order of their ids, so the fit is the same wherever they
    were read. None where there is no row.
    """
    ship(rows.sparkSession)

    def run(batches):
        def chunks():
            for part, texts in text_chunks(batches, "text"):
                yield texts, part.column(2).to_numpy(), part.column(3).to_numpy()

        stream = chunks()
        first = next(stream, None)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(chain([first], stream)))], pa.binary())], names=["model"])

    made = rows.repartition(1).sortWithinPartitions("id").mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0][0]) if made else None
