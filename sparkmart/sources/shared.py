"""Folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that spark.checkpoint.dir names; it goes when the driver ends.

    Where that setting is empty a temporary folder is taken, but only for a local master: executors elsewhere would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkmart-")
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/sparkmart-{uuid.uuid4().hex}"
    atexit.register(remove, spark, root)
    return f"{root}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass
