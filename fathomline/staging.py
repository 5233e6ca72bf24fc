"""Written tables that cut lineage.

A table is written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir`` (shared by driver and executors) and read back, so that a
lost executor costs a re-read and never a recomputation of the whole plan. Only
where the session names no folder (tests, a laptop) a temporary one is made.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one for local masters only."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="fathomline-")
    return _local[app]


class Scratch:
    """Tables of one operator call, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/fathomline-{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a frame that reads the written files."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        schema = df.schema
        df.write.parquet(path)
        if self._n == 1:  # the whole folder goes when the application ends
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        out = self.spark.read.schema(schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def settle(self) -> None:
        """Let the driver collect its garbage: shuffle files of finished steps go now, not when it happens to run short of memory."""
        for _ in range(2):  # what Python lets go reaches the JVM a little later; files go after a second look
            gc.collect()
            time.sleep(0.5)
            self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete the files behind a frame that ``save`` returned and nobody needs."""
        path = self._paths.pop(id(df), None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def in_ranges(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """The rows, written, with ``_slice``: ranges of about equal size that rise with ``order``, ties of its first columns included."""
    return scratch.save(rows.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))


def shrink_executors(spark: SparkSession) -> None:
    """Ask the executors' JVMs to give unused heap back to the system (a full collection), ahead of a step whose Python workers need the memory.

    A JVM otherwise keeps what earlier steps made it take. One short task for each
    core; nothing is read or kept.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()
