"""The shop's source tables landed once as Parquet, so that models scan them rather than derive them each time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .registry import Source
from .shared import new_folder
from .warehouse import from_driver_tables

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def state(spark: SparkSession, folder: str) -> tuple:
    """Size and time of change of the tables' files: what is landed counts only as long as these stay."""
    out = []
    for t in TABLES:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}.parquet")
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(at):
            out += [(t, s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(at)]
    return tuple(sorted(out))


def landed(spark: SparkSession, folder: str) -> Source:
    """Source tables derived from the star schema in `folder`; each is written to the shared folder when it is first asked for.

    A session keeps what it has landed of a folder until the folder's files change.
    """
    kept = spark.__dict__.setdefault("_sparkmart_landed", {})
    key = (folder, state(spark, folder))
    if key not in kept:
        raw, base = from_driver_tables(spark, folder), new_folder(spark, "sources")

        def land(name: str):
            df, path = raw.table(name), f"{base}/{name}.parquet"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        kept[key] = Source({n: (lambda n=n: land(n)) for n in raw.make})
    return kept[key]
