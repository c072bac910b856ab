"""The models over a shop in their own schema: keys, tests, sums, and the plans that Spark makes of them."""

import pytest
from pyspark.sql import functions as F

from sparkmart.operators import data_tests as dt
from sparkmart.plans import MODELS, Graph
from sparkmart.sources import SCHEMAS, contract, from_driver_tables
from sparkmart.sources.fixture import STATUS
from sparkmart.sources.registry import schema


def test_fixture_volumes(shop):
    n = {t: shop.source.table(t).count() for t in SCHEMAS}
    assert n == {"distribution_centers": 10, "products": 200, "users": 400, "orders": 3000, "order_items": 8000, "inventory_items": 10000, "events": 20000}
    assert all(not contract(shop.source.table(t).schema, schema(t)) for t in SCHEMAS)


def test_there_are_thirty_models():
    assert len(MODELS) == 30
    assert {m.layer for m in MODELS.values()} == {"staging", "intermediate", "mart"}
    assert all(m.grain for m in MODELS.values())


@pytest.mark.parametrize("name", list(MODELS))
def test_keys(shop, name):
    df, key = shop[name], MODELS[name].key
    row = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("k"), F.count_if(F.col(key).isNull()).alias("z")).first()
    assert row["n"] == row["k"] > 0 and row["z"] == 0


def test_singular_tests_pass(shop):
    orders, items = shop["stg_orders"], shop["stg_order_items"]
    assert dt.orphan_items(items, orders, shop["stg_users"], shop["stg_products"]).isEmpty()
    assert dt.item_counts(orders, items, shop["fct_orders"]).isEmpty()
    assert dt.lifecycle(orders, items).isEmpty()
    assert dt.plausible(orders, items).isEmpty()


def test_checks_pass(shop):
    for checks in (dt.source_checks(shop.source.table), dt.staging_checks(shop)):
        assert {r["check_name"]: r["violations"] for r in dt.counted(*checks).collect() if r["violations"]} == {}
    assert all(r["ok"] for r in dt.reconciled(shop).collect())


def test_planted_faults_are_found(shop, spark):
    items = shop["stg_order_items"]
    lost = shop["stg_orders"].where("order_id <> 5")
    assert dt.orphan_items(items, lost, shop["stg_users"], shop["stg_products"]).where("missing_order").count() == items.where("order_id = 5").count() > 0
    assert {r["value"]: r["n"] for r in dt.accepted_values(shop["stg_orders"], "status", STATUS[1:]).collect()} == {STATUS[0]: shop["stg_orders"].where(F.col("status") == STATUS[0]).count()}
    twice = items.unionByName(items.where("order_item_id = 7"))
    assert [tuple(r) for r in dt.unique(twice, "order_item_id").collect()] == [(7, 2)]
    assert dt.not_null(shop["stg_inventory"], "sold_at").count() == 2000
    assert dt.relationships(items, "order_id", lost, "order_id").count() == items.where("order_id = 5").count()
    for severity, passed in (("warn", True), ("error", False)):
        assert dt.Test("t", lambda: twice, severity).run()["passed"] is passed
    with pytest.raises(ValueError):
        dt.accepted_values(items.withColumn("b", F.lit(True)), "b", [True])
    with pytest.raises(ValueError):
        dt.Test("t", lambda: twice, "fatal")


def test_values(shop):
    retention = shop["mart_cohort_retention"]
    assert retention.where("months_since_cohort = 0 and retention_rate <> 1.0").isEmpty()
    assert retention.where("retention_rate not between 0 and 1").isEmpty()
    assert shop["mart_customer_summary"].where("lifetime_orders = 0 and average_order_value is not null").isEmpty()
    days = shop["dim_date"].agg(F.count("*").alias("n"), F.max("days_since_first_order").alias("d")).first()
    assert days["n"] == days["d"] + 1
    first = shop["mart_product_performance"].take(2)
    assert first[0]["gross_revenue"] >= first[1]["gross_revenue"]
    assert shop["int_products_returns"].where("units_sold = 0 and return_rate is not null").isEmpty()


def test_mart_types(shop):
    row = shop["mart_types"].first()
    assert row["int_array"] == [1, 2, 3] and row["pair_struct"].asDict() == {"id": 1, "channel": "web"} and row["pair_json"] == '{"id":1,"channel":"web"}'


def test_sources_are_read_only(shop):
    with pytest.raises(PermissionError):
        shop.source.write("orders")
    with pytest.raises(KeyError):
        shop.source.table("nothing")
    with pytest.raises(KeyError):
        shop["nothing"]


def test_contract_arms():
    want = schema("products")
    found = type(want)([f for f in want if f.name != "cost"]).add("more", "string")
    assert contract(found, want, ["id", "ghost"]) == ["missing: cost", "undeclared: ghost"]


def test_scan_reads_only_what_is_used(spark, data):
    plan = Graph(from_driver_tables(spark, data), spark)["mart_daily_revenue"]._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_discount" not in plan
    assert "PythonUDF" not in plan and "Pandas" not in plan


def test_build_writes_marts(shop, spark, tmp_path):
    paths = shop.build(str(tmp_path))
    assert len(paths) == 12
    assert spark.read.parquet(paths["fct_orders"]).count() == 3000
