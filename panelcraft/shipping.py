"""Gives the package to the Python workers of a session that was started elsewhere."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source files to all executors, once per application. An installed package needs no shipping."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="panelcraft-")) / "panelcraft.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as files:
        for path in sorted(root.rglob("*.py")):
            files.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))  # Spark serves it from the driver
    _shipped.add(application)
