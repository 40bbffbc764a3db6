"""The package itself, as executors need it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="motifmill-ship-")  # the driver serves the file from here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = f"{folder}/{root.name}-{context.applicationId}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()
