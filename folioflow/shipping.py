"""Sends this package to the executors of an application."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once an application, so that the executors' Python can import the package wherever it is installed on the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_folioflow_sent", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="folioflow-"), "folioflow.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("folioflow", os.path.relpath(full, root)))
    sc.addPyFile(out)
    sc._folioflow_sent = True
