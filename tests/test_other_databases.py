"""Tables of another database, read by executors that are processes of their own."""

import os
import subprocess
import sys

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkmart.sources import files, measure

FAR = """
import sys
from pyspark.sql import SparkSession
from sparkmart import catalog, evidence
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", f"file://{sys.argv[2]}").config("spark.ui.enabled", "false").config("spark.sql.ansi.enabled", "true").getOrCreate()
for name in ("io_remote_scan", "io_remote_query", "j_catalogs"):
    print("ROWS", name, len(catalog.QUERIES[name](spark, sys.argv[1]).collect()))
spark.stop()
"""


def test_executors_beside_the_driver_read_it(data, tmp_path):
    (tmp_path / "shared folder").mkdir()
    found = subprocess.run([sys.executable, "-c", FAR, data, str(tmp_path / "shared folder")], cwd=tmp_path, env=os.environ | {"SPARK_SCALA_VERSION": "2.13", "SPARK_WORKER_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    customers = pq.read_metadata(f"{data}/customer.parquet").num_rows
    assert [x.split()[1:] for x in found.stdout.splitlines() if x.startswith("ROWS")] == [["io_remote_scan", "4"], ["io_remote_query", "5"], ["j_catalogs", str(customers)]], found.stderr[-2000:]


def test_values_of_every_kind_and_null(spark):
    df = spark.sql("select * from values (1, 'a', 1.5d, 2.25BD, date'2020-01-02', timestamp_ntz'2020-01-02 03:04:05.123456', true), (null, null, null, null, null, null, null) t(i, s, x, m, d, t, b)")
    got = files.remote_table(spark, measure.derby(spark, kinds=df), "KINDS", driver=measure.DERBY)
    assert sorted(map(tuple, got.select(*df.columns).withColumn("t", F.col("t").cast("timestamp_ntz")).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_a_folder_that_derby_cannot_open_is_refused(spark, monkeypatch):
    monkeypatch.setattr(measure, "new_folder", lambda spark, name: f"hdfs://far/{name}")
    with pytest.raises(RuntimeError, match="file scheme"):
        measure.derby(spark, none=spark.range(1))
