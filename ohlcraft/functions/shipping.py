"""The package for Python workers whose path doesn't have it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_ohlcraft_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    made = tempfile.mkdtemp(prefix="ohlcraft-zip-")  # the driver's own copy, served to the executors
    stage = Path(made, "src")
    shutil.copytree(package, stage / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{made}/{package.name}", "zip", stage))
    sc._ohlcraft_shipped = True
