"""Resumable runs: skip what is done, and process images as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def pending(work: DataFrame, done: DataFrame, key: str = "image_id") -> DataFrame:
    """Work whose key is not among the finished (also those that found nothing)."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def run_stream(arrivals: DataFrame, detect: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "image_id") -> StreamingQuery:
    """Detect in each micro-batch of arriving rows; results and finished keys are written per batch.

    A batch that is repeated after a failure overwrites its own folder, so each row
    counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        detect(batch).write.mode("overwrite").parquet(f"{out}/detections/batch={number}")
        batch.select(key).distinct().write.mode("overwrite").parquet(f"{out}/done/batch={number}")
        batch.unpersist()

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
