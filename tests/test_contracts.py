from sparkmart.operators import contracts
from sparkmart.plans import Graph
from sparkmart.sources import files, from_driver_tables


def test_models_bind_to_declared_sources(spark):
    assert contracts.unbound_models(spark) == []


def test_driver_tables_keep_the_contract(spark, data):
    assert contracts.broken_sources(from_driver_tables(spark, data)) == []


def test_models_hold_nothing_forbidden(tmp_path):
    assert contracts.lint() == []
    (tmp_path / "bad.py").write_text("x = spark.sql('select 1')\ny = 2\nz = df.rdd\n")
    assert contracts.lint(str(tmp_path)) == ["bad.py:1: x = spark.sql('select 1')", "bad.py:3: z = df.rdd"]


def test_plans_stay_in_the_jvm(spark, data):
    graph = Graph(from_driver_tables(spark, data), spark)
    assert contracts.python_in_plan(graph["mart_customer_summary"]) == []


def test_listing():
    listed = contracts.function_listing()
    assert len(listed) >= 24 and any(x.startswith("quotient(amount, count): Money over") for x in listed)


def test_insert_and_drop(spark, tmp_path):
    spark.sql(f"CREATE TABLE kept (a BIGINT, b STRING) USING parquet LOCATION '{tmp_path}/kept'")
    files.insert_rows(spark, "kept", spark.createDataFrame([("x", 1)], "b string, a long"))
    assert [tuple(r) for r in spark.table("kept").collect()] == [(1, "x")]
    files.drop_table(spark, "kept")
    assert not spark.catalog.tableExists("kept")


def test_partition_summary(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), (None, 3)], "p string, k long")
    assert {tuple(r) for r in files.partition_summary(df, "p", "k").collect()} == {("a", 2, 1, 5), (None, 1, 3, 3)}
