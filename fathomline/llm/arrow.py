"""Helpers for Arrow-batched Python stages."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.shipping import ship

#: Text bytes handled at once in a Python worker; longer single texts make a chunk of their own.
CHUNK_BYTES = 1 << 20


_tables: dict[str, dict] = {}


def worker_table(operator: str, table: dict) -> dict:
    """Register a table that an operator keeps in Python workers between tasks."""
    _tables[operator] = table
    return table


def only_tables_of(operator: str) -> None:
    """Empty what other operators left in this worker, and give its memory back; workers outlive a stage."""
    left = [table for name, table in _tables.items() if name != operator and table]
    for table in left:
        table.clear()
    if left:
        gc.collect()  # an encoder's tables refer to each other
        give_back()


def give_back() -> None:
    """Return what this worker has freed to the system: idle workers would keep it beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def shrink_workers(spark: SparkSession) -> None:
    """Have idle Python workers empty their tables and give back what they have freed, ahead of a step of other workers.

    A step with two Python stages in one task leaves more workers than cores. They
    take their turns, so some short tasks for each core reach all; nothing is read or kept.
    """
    ship(spark)
    n = 4 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_tables_of("")
        yield from batches
        give_back()

    spark.range(0, n, 1, n).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def text_chunks(batches: Iterator[pa.RecordBatch], text: str | int = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of at most ``most`` text bytes (or one row) with their texts, null as ''."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(text)
        sizes = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)))
        at = 0
        while at < n:
            base = sizes[at - 1] if at else 0.0
            end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
            part = batch.slice(at, end - at)
            texts = [t or "" for t in column.slice(at, end - at).to_pylist()]
            yield part, texts
            at = end


def map_texts(df: DataFrame, keys: list[str], text: str, schema: str, work: Callable[[list[str]], dict[str, object]], setup: Callable[[], Callable] | None = None, operator: str = "", most: int = CHUNK_BYTES) -> DataFrame:
    """``keys`` plus the columns that ``work(texts)`` returns for each chunk of rows.

    ``work`` gets a list of texts (null is '') and returns one sequence per column
    of ``schema`` beyond the keys. With ``setup`` the callable is made once per task.
    Tables of operators other than ``operator`` are emptied in the worker first.
    A chunk has at most ``most`` bytes of text, or one row. Input columns with other
    names never reach Python.
    """
    ship(df.sparkSession)
    names = [f"_k{i}" for i in range(len(keys))]
    source = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], F.col(f"`{text}`").cast("string").alias("_t"))
    key_types = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    full = f"{key_types}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_tables_of(operator)
        fn = setup() if setup else work
        for part, texts in text_chunks(batches, "_t", most):
            made = fn(texts)
            cols = [part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, *[x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in made.values()]], names=[*names, *made])
        give_back()

    out = source.mapInArrow(run, full)
    for k, n in zip(keys, names, strict=True):
        out = out.withColumnRenamed(n, k)
    return out
