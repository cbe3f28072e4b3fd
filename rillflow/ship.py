"""Sends this package to the executors of a session, for clusters on which it is not installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per Spark context; Spark serves the archive from the driver to every executor, new ones included."""
    context = spark.sparkContext
    if getattr(context, "_rillflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="rillflow-")), "rillflow.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(target)
    context._rillflow_shipped = True
