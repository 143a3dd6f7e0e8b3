"""Getting the package to Python workers that cannot import it by themselves."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    zipped = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quarrion-')}/quarrion", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(zipped)
