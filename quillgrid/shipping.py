"""Sends the package to executors, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once a context."""
    context = spark.sparkContext
    if getattr(context, "_quillgrid_shipped", False):
        return
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="quillgrid-"), "quillgrid.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(path)
    context._quillgrid_shipped = True


def shipped(f: Callable) -> Callable:
    """``f(spark, ...)`` with the package sent first."""

    @wraps(f)
    def call(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return call
