"""Files: values survive, orders hold, partitions are pruned, limits are kept."""

import datetime as d
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkmart.functions import physical_layout
from sparkmart.operators import verify
from sparkmart.sources import files

WIDE = "id long, n decimal(38,9), x double, s string, b boolean, dt date, ts timestamp_ntz, bin binary, arr array<long>, st struct<a:long,b:string>, arr_st array<struct<x:long>>"


@pytest.fixture(scope="module")
def wide(spark):
    rows = [
        (2**53 + k, Decimal(k).scaleb(-9), k / 7, f'é "{k}", \n', k % 2 == 0, d.date(2024, 1, 1 + k % 28), d.datetime(2024, 1, 1, 0, 0, k % 60, k), bytearray([k % 256]), [k, k + 1], (k, "x"), [(k,)])
        if k % 100
        else (k, *[None] * 10)
        for k in range(1000)
    ]
    return spark.createDataFrame(rows, WIDE)


def test_parquet_keeps_every_value(spark, wide, tmp_path):
    files.export(wide, str(tmp_path / "p"), shards=3)
    assert verify.verdict(wide, files.read_parquet(spark, str(tmp_path / "p"))).same
    assert files.rows_per_file(spark, str(tmp_path / "p")).agg(F.count("*"), F.sum("n_rows")).first()[:] == (3, 1000)


def test_csv_with_null_marker(spark, wide, tmp_path):
    rows = wide.withColumn("s", F.regexp_replace("s", "\n", " "))
    files.write_csv(rows, str(tmp_path / "c"))
    assert "\\N" in spark.read.text(str(tmp_path / "c")).where("value like '0,%'").first()[0]
    back = files.read_csv(spark, str(tmp_path / "c"), rows.schema)
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert verify.verdict(rows, back).same


def test_csv_refuses_nested_columns(spark, wide, tmp_path):
    with pytest.raises(Exception, match="UNSUPPORTED_DATA_TYPE"):
        wide.select("arr").write.csv(str(tmp_path / "n"))


def test_ordered_export(spark, tmp_path):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    files.export(df, str(tmp_path / "o"), shards=4, order=["k"])
    back = files.read_parquet(spark, str(tmp_path / "o")).withColumn("position", F.monotonically_increasing_id())
    got = files.row_order(back, "k").first()
    assert (got["n_rows"], got["first"], got["last"]) == (1000, 0, 999)
    assert got["descents"] <= 3  # files may be read in another order than their names


def test_tagged_export_is_a_folder_each(spark, tmp_path):
    files.export_tagged(str(tmp_path / "t"), a=spark.range(3), b=spark.range(5))
    assert {r["source"]: r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("source").count().collect()} == {"a": 3, "b": 5}


def test_layout_prunes(spark, tmp_path):
    df = spark.range(366).selectExpr("id product_id", "timestamp_ntz '2024-01-01' + make_dt_interval(cast(id as int)) created_at")
    layout = physical_layout()
    layout.write(df, str(tmp_path / "l"))
    stored = spark.read.parquet(str(tmp_path / "l"))
    march = layout.between(stored, "2024-03-01", "2024-04-01")
    assert march.count() == 31 and march.columns == ["product_id", "created_at"]
    assert "PartitionFilters: [isnotnull(created_at_month" in march._jdf.queryExecution().executedPlan().toString()
    assert files.scanned(march)["partition_filters"] == 1


def test_guard_and_estimate(spark):
    assert files.estimated_bytes(spark.range(10)) == 80
    files.guarded(spark.range(10), 80)
    with pytest.raises(RuntimeError):
        files.guarded(spark.range(10), 79)


def test_land(spark, tmp_path):
    spark.range(5).selectExpr("id", "timestamp_ntz '2024-01-01' t").write.parquet(str(tmp_path / "x"))
    with pytest.raises(TypeError):
        files.land(spark, str(tmp_path / "x"), "landed", ("t",))
    spark.conf.set("spark.sql.sources.commitProtocolClass", "org.apache.spark.sql.execution.datasources.SQLHadoopMapReduceCommitProtocol")
    out, moved = files.as_instants(spark.read.parquet(str(tmp_path / "x")), "t")
    assert dict(out.dtypes)["t"] == "timestamp" and moved.isEmpty()


def test_columns_of(spark, wide):
    assert files.columns_of(wide).count() == 11
