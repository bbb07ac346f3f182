"""Makes this package importable in Spark's Python workers when it isn't installed there."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, unless their PYTHONPATH already holds it."""
    context = spark.sparkContext
    known = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(_ROOT) in known or context.applicationId in _sent:
        return
    folder = tempfile.mkdtemp(prefix="tidemill-")
    context.addPyFile(shutil.make_archive(f"{folder}/tidemill", "zip", _ROOT, "tidemill"))
    _sent.add(context.applicationId)
