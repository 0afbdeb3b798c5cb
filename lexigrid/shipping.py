"""Send this package to the executors' Python, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the session's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexigrid-code-"), "lexigrid.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for here, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    z.write(full, os.path.join("lexigrid", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)  # Spark's file server hands it to every executor
    _sent.add(app)
