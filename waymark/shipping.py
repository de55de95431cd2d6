"""Gives the package's code to the Python workers of an application, wherever they run.

It also bounds what one Arrow batch holds by bytes, since rows may be long texts:
Spark's own bound is by rows, and buffers for whole batches stay in memory.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of rows in an Arrow batch that goes to a Python worker.
BATCH_BYTES = "4m"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Spark's own file server sends the archive; done once for each application."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = f"{tempfile.mkdtemp(prefix='package-')}/waymark_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(package.glob("**/*.py")):
                z.write(path, path.relative_to(package.parent))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
