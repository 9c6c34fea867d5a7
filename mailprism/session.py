"""The session the engine expects: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """On a cluster leave both to spark-defaults; tests pass local[n] and a small count of partitions."""
    b = SparkSession.builder.appName("mailprism")
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    }.items():
        b = b.config(k, v)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_mailprism_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="mailprism-")) / "mailprism.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(path))
    context._mailprism_shipped = True
