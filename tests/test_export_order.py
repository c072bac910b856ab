"""Order of a whole export: within files and between neighbours."""

from pyspark.sql import functions as F

from sparkmart import catalog
from sparkmart.sources import files


def test_whole_export(spark, tmp_path):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"))
    files.export(df, str(tmp_path / "o"), shards=4, order=["k"])
    got = files.export_order(spark, str(tmp_path / "o"), "k").orderBy("filename").collect()
    assert len(got) == 4 and sum(r["n_rows"] for r in got) == 5000 and not any(r["descents"] for r in got)
    assert all(a["last"] < b["first"] for a, b in zip(got, got[1:]))


def test_wrong_orders_show(spark, tmp_path):
    for k, (low, high) in enumerate([(0, 1500), (3000, 4000), (2000, 3000)]):
        spark.range(low, high, 1, 1).select(F.col("id").alias("k")).write.parquet(str(tmp_path / f"w{k}"))
        part = next((tmp_path / f"w{k}").glob("*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        part.rename(tmp_path / "all" / f"part-{k}.parquet")
    assert [r["descents"] for r in files.export_order(spark, str(tmp_path / "all"), "k").orderBy("filename").collect()] == [0, 0, 1]
    spark.createDataFrame([(3,), (1,), (2,)], "k long").coalesce(1).write.parquet(str(tmp_path / "x"))
    assert files.export_order(spark, str(tmp_path / "x"), "k").first()["descents"] == 1


def test_row_order_query_exports_every_order(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "_folder", lambda s, name: str(tmp_path / name))
    catalog.QUERIES["io_row_order"](spark, data).collect()
    assert spark.read.parquet(str(tmp_path / "ordered")).count() == spark.read.parquet(f"{data}/orders.parquet").count() > 1000
