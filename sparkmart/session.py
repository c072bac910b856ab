"""A session as the library wants it, and the package on every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session: UTC, ANSI, adaptive execution. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkmart")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


#: Bytes of a batch that goes to a Python worker, so that long rows take no more memory than short ones.
BATCH = 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context, so that functions on them can import it, and bounds their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    context = spark.sparkContext
    if getattr(context, "_sparkmart_sent", False):
        return spark
    here = Path(__file__).parent
    handle, name = tempfile.mkstemp(prefix="sparkmart-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as out:
        for p in sorted(here.rglob("*.py")):
            out.write(p, p.relative_to(here.parent))
    context.addPyFile(name)
    context._sparkmart_sent = True
    return spark
