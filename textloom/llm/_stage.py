"""Staging of the core, and what Python workers need."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from textloom.shared import BROADCAST_ROWS, forget, shared_dir, small_side, staged

__all__ = ["BROADCAST_ROWS", "forget", "shared_dir", "ship", "small_side", "staged"]


def ship(spark: SparkSession) -> None:
    """Give this package to Python workers that have no copy of it, once for each application, and keep Arrow batches small.

    Rows are whole texts here: with batches of a few MB a worker's memory does not depend on their number.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(path))
    context._textloom_shipped = True
