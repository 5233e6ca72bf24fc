"""Makes this package importable in Python workers wherever the driver found it, and bounds what they get at once."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of a batch to Python, where the session has Spark's default: a batch of whole texts is held several
#: times on its way, in the JVM and in the worker.
_BATCH, _DEFAULT_ROWS, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    if spark.conf.get(_BATCH, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_BATCH, _ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    if root.suffix == ".zip" or not root.is_dir():  # already run from a shipped archive
        return
    target = os.path.join(tempfile.mkdtemp(prefix="fathomline-"), "fathomline.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
