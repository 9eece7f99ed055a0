"""Sends this package to the Python workers of a session, so that they need no shared path to it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Bytes of a batch for Python workers; long texts then come a few at a time. A session's own setting is replaced.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's source to the session's Python files, once for an application."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) != str(BATCH_BYTES):
        spark.conf.set(bound, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _sent:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _sent.add(app)
    return spark
