"""Digests, profiles and differences: equal builds agree, planted differences are found, no others are."""

import datetime as d
from decimal import Decimal

from pyspark.sql import functions as F

from sparkmart.operators import verify as v

ROWS = [
    (1, 0.5, True, d.date(2024, 1, 2), d.datetime(2024, 1, 2, 3, 4, 5), "a", Decimal("12.30")),
    (2, -1.25, False, d.date(1999, 12, 31), d.datetime(1999, 12, 31), "é", Decimal("12.00")),
    (3, None, None, None, None, None, None),
    (4, 1e-9, True, d.date(2024, 1, 2), d.datetime(2024, 1, 2, 0, 0, 0, 1), "", Decimal("-0.01")),
]
SCHEMA = "i long, f double, b boolean, d date, t timestamp_ntz, s string, m decimal(18,2)"


def test_digests_forget_order_and_scale(spark):
    a = spark.createDataFrame(ROWS, SCHEMA)
    b = spark.createDataFrame(ROWS[::-1], SCHEMA).withColumns({"m": F.col("m").cast("decimal(38,9)"), "i": F.col("i").cast("int"), "t": F.col("t").cast("timestamp")})
    assert v.verdict(a, b).same
    c = a.withColumn("m", F.when(F.col("i") == 2, F.col("m") + 1).otherwise(F.col("m")).cast("decimal(18,2)"))
    assert v.verdict(a, c).differences == ["m: digest"]
    assert v.verdict(a, c, ignore=("m",)).same
    assert v.verdict(a, a.unionByName(a)).differences != []
    assert v.verdict(a, a.select("s", "i", "f", "b", "d", "t", "m")).differences == ["order of columns"]


def test_canonical_texts(spark):
    df = spark.createDataFrame([([3, 1, None], (1, None), Decimal("10.500000000"), float("nan"), bytearray(b"\x01\xff"))], "a array<long>, s struct<x:long,y:string>, m decimal(38,9), f double, b binary")
    row = df.select(*(v.canonical(F.col(f.name), f.dataType) for f in df.schema)).first()
    assert tuple(row) == ("1,3,<null>", "x=1;y=<null>", "10.5", "nan", "01FF")
    assert [v.kind(f.dataType) for f in df.schema] == ["array<int>", "struct<x:int,y:string>", "decimal", "float", "bytes"]


def test_four_planted_differences(spark):
    a = spark.range(100).selectExpr("id", "cast(id * 1.5 as decimal(38,9)) m", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id) t", "concat('Name ', id) s")
    b = a.where("id <> 9").withColumns({
        "m": F.when(F.col("id") == 10, F.col("m").cast("decimal(30,9)") + F.lit("0.000000001").cast("decimal(10,9)")).otherwise(F.col("m")).cast("decimal(38,9)"),
        "t": F.when(F.col("id") == 11, F.expr("t + interval 1 millisecond")).otherwise(F.col("t")),
        "s": F.when(F.col("id") == 12, F.concat(F.lower("s"), F.lit(" "))).otherwise(F.col("s")),
    })
    got = {r["column_name"]: (r["identical"], r["equivalent"], r["different"], r["only_left"], r["only_right"], r["example"]) for r in v.row_diff(a, b, "id").collect()}
    assert got == {"m": (98, 0, 1, 1, 0, "10"), "t": (98, 0, 1, 1, 0, "11"), "s": (98, 0, 1, 1, 0, "12")}
    assert v.rendered(a.where("id <> 9"), b, "id").count() == 3
    assert [tuple(r) for r in v.delta_histogram(a, b, "id", "m").collect()] == [(Decimal("-1E-9"), 1)]
    assert v.repeated_keys(a.unionByName(a.where("id = 3")), "id").first()["n"] == 2


def test_equivalent_cells(spark):
    a = spark.range(10).selectExpr("id", "timestamp_ntz '2024-01-01' t", "cast(id as decimal(10,2)) m")
    b = a.selectExpr("id", "cast(t as timestamp) t", "cast(m as decimal(38,9)) m")
    assert {(r["identical"], r["equivalent"], r["different"]) for r in v.row_diff(a, b, "id").collect()} == {(0, 10, 0)}


def test_profile(spark):
    got = {r["column_name"]: tuple(r)[1:] for r in v.profile(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got["i"] == (4, 4, 4, "10", "1", "4")
    assert got["m"] == (4, 3, 3, "24.29", "-0.01", "12.3")
    assert got["s"] == (4, 3, 3, "2", "", "é")
    assert v.close("1.0000000001", "1.0", True) and not v.close("1.1", "1.0", True) and not v.close(None, "1")


def test_two_step_rounding(spark):
    df = spark.createDataFrame([(6.644999999552965,), (1.0,), (None,)], "x double")
    assert [tuple(r) for r in v.two_step_rounding(df, "x").collect()] == [(6.644999999552965, Decimal("6.64"), Decimal("6.65"))]


def test_scale_attribution(spark):
    rows = [(1, "1.00", "1.00", "1.00"), (2, "1.23", "1.234", "1.234"), (3, "1.23", "1.234", "1.235"), (4, "1.23", "1.234", "9")]
    df = spark.createDataFrame(rows, "k long, a string, b string, c string")
    side = lambda c: df.select("k", F.col(c).cast("decimal(38,9)").alias("x"))
    assert {r["bucket"]: r["n"] for r in v.scale_attribution(side("a"), side("b"), side("c"), "k", "x").collect()} == {"identical": 1, "A": 1, "B": 1, "C": 1}
