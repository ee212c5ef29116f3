"""The package as a zip that Spark hands to its Python workers, wherever they run."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_tilewright_shipped", False):
        return
    top = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="tilewright-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(name)
    context._tilewright_shipped = True


def shipped(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``run`` with the package sent first."""
    @functools.wraps(run)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return call
