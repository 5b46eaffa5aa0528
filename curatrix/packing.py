"""Ships this package to the Python workers, which may run where it is not installed, and bounds what they hold."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of one Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 1000
#: Bytes of one Arrow batch, where this Spark knows the setting.
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size of this session to BATCH_ROWS rows and BATCH_BYTES bytes, if it is higher."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(key, None)).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession | None = None) -> None:
    """Add the package to the session's Python files, once for each context, and keep the session's Arrow batches small."""
    spark = spark or SparkSession.active()
    bounded_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_curatrix_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="curatrix-")) / "curatrix.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(path))
    context._curatrix_shipped = True
