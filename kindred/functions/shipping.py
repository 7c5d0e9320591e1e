"""Gives the Python workers this package, wherever the driver has it from."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None) -> None:
    """Hand the package's modules to the executors, once for a SparkContext, as --py-files would.

    Spark serves the file from the driver, so executors need no common folder and no installation.
    """
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext if spark else None
    if context is None or getattr(context, "_kindred_shipped", False) or not root.is_dir():
        return
    path = f"{os.path.realpath(tempfile.mkdtemp(prefix='kindred-code-'))}/kindred-code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(path)
    context._kindred_shipped = True
