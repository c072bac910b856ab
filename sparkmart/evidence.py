"""More queries of the catalog: files and other databases, row ids, types, and the evidence of verification."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import functions as fn
from .catalog import _DECIMAL, _PRICES, graph, query, read
from .operators import contracts, verify
from .operators import data_tests as dt
from .operators import evidence as ev
from .plans import MODELS
from .sources import files, fixture, from_driver_tables, measure
from .sources.registry import SCHEMAS, contract, schema
from .sources.shared import new_folder


def constant(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def refused(f) -> bool:
    try:
        f()
    except Exception:  # noqa: BLE001  that it raises is what is asked for
        return True
    return False


def values(rows: list[tuple], *names: str) -> str:
    """SQL of a constant relation."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({', '.join(names)})"


# files


@query("SELECT 3::BIGINT AS files, count(*)::BIGINT AS n_rows, true AS named FROM supplier")
def io_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each file of an explicit list."""
    path = new_folder(spark, "listed")
    files.export(read(spark, sf_dir, "supplier"), path, shards=3)
    listed = sorted(spark.read.parquet(path).inputFiles())
    rows = files.rows_per_file(spark, *listed)
    return rows.agg(F.count("*").alias("files"), F.sum("n_rows").alias("n_rows"), F.bool_and(F.col("filename").endswith(".parquet")).alias("named"))


@query(values([(0, "n_nationkey", "int"), (1, "n_name", "string"), (2, "amount", "decimal(38,9)"), (3, "numbers", "array<bigint>"), (4, "pair", "struct<a:bigint,b:string>")], "position", "column_name", "type"))
def io_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "schema")
    pair = fn.struct_of(("a", F.lit(1), fn.INT), ("b", F.col("n_name"), fn.STRING))
    read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", fn.money(F.lit(1)).alias("amount"), fn.int_series(1, 2).alias("numbers"), pair.alias("pair")).write.parquet(path)
    return files.columns_of(spark.read.parquet(path)).withColumn("position", F.col("position").cast("long"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def io_csv_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV column that carries JSON, read back as text and parsed by a declared type."""
    path, rows = new_folder(spark, "csv_json"), read(spark, sf_dir, "events").select("event_id", "props")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def derby(spark: SparkSession, sf_dir: str, *tables: str) -> str:
    """A database beside Spark's, with some tables, that the driver and all executors can open."""
    return measure.derby(spark, **{t: read(spark, sf_dir, t) for t in tables})


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2")
def io_remote_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of another database in ranges of a key; filters and columns must have been pushed to it."""
    rows = files.remote_table(spark, derby(spark, sf_dir, "nation"), "NATION", "n_nationkey", (0, 25), 3, driver=measure.DERBY)
    out = rows.where("n_regionkey = 1 and n_nationkey > 2").select("n_nationkey", "n_name")
    plan = out._jdf.queryExecution().executedPlan().toString()
    if "EqualTo(n_regionkey,1)" not in plan.replace("*", "") or "n_comment" in plan:
        raise RuntimeError(f"not pushed down: {plan}")
    return out


@query("SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def io_remote_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate that the other database computes, after a dry run under a limit."""
    rows = files.remote_query(spark, derby(spark, sf_dir, "nation"), 'SELECT "n_regionkey" AS "n_regionkey", COUNT(*) AS "n" FROM NATION GROUP BY "n_regionkey"', driver=measure.DERBY)
    return files.guarded(rows, 1 << 63).select("n_regionkey", F.col("n").cast("long").alias("n"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of tables of two catalogs: files here, tables of another database there."""
    name = f"remote{uuid.uuid4().hex[:8]}"
    measure.remote_catalog(spark, name, derby(spark, sf_dir, "nation", "region"))
    nation, region = (spark.table(f"{name}.APP.{t}") for t in ("NATION", "REGION"))
    return read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT coalesce(s.row_id, n.row_id)::BIGINT AS row_id, s_suppkey, n_nationkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS row_id FROM supplier) s FULL JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS row_id FROM nation) n ON s.row_id = n.row_id")
def j_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row i of one table with row i of another, by ids of an ordered export."""
    a = measure.numbered(read(spark, sf_dir, "supplier").select("s_suppkey"), new_folder(spark, "a"), "s_suppkey")
    b = measure.numbered(read(spark, sf_dir, "nation").select("n_name", "n_nationkey"), new_folder(spark, "b"), "n_name", shards=3)
    return measure.positional(a, b.drop("n_name"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey)::BIGINT AS row_id FROM orders")
def w_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids in a total order, without a window over the whole table."""
    return measure.numbered(read(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), new_folder(spark, "ids"), "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("SELECT 'full' AS scan, true AS whole, count(*)::BIGINT AS n_rows FROM lineitem UNION ALL SELECT 'filtered', false, count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-04-01'")
def io_scan_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, and by the scans' own metrics whether all bytes were read: the filtered scan must read less than a tenth."""
    path, layout = new_folder(spark, "lines"), fn.physical_layout("l_shipdate", sort="l_partkey")
    layout.write(read(spark, sf_dir, "lineitem").select("l_shipdate", "l_partkey", "l_quantity"), path)
    full = spark.read.parquet(path)
    month = layout.between(full, "1996-03-01", "1996-04-01")
    got = {r["scan"]: r for r in measure.pruning(full, month).collect()}
    if 10 * got["filtered"]["bytes"] >= got["full"]["bytes"] or got["filtered"]["files"] >= got["full"]["files"]:
        raise RuntimeError(f"not pruned: {got}")
    return constant(spark, [("full", True, got["full"]["rows"])], "scan string, whole boolean, n_rows long").unionByName(month.agg(F.lit("filtered").alias("scan"), F.lit(False).alias("whole"), F.count("*").alias("n_rows")))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 99, 'Extra'")
def io_ctas_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made from a query, a row inserted by column names, read back, and dropped."""
    name = f"sparkmart_{uuid.uuid4().hex}"
    files.create_table(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), name)
    files.insert_rows(spark, name, spark.createDataFrame([("Extra", 99)], "n_name string, n_nationkey int").withColumn("n_nationkey", F.col("n_nationkey").cast(spark.table(name).schema["n_nationkey"].dataType)))
    path = new_folder(spark, "copy")
    spark.table(name).write.parquet(path)
    files.drop_table(spark, name)
    if spark.catalog.tableExists(name):
        raise RuntimeError("the table is still there")
    return spark.read.parquet(path)


@query("SELECT 'nation' AS source, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def io_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tagged")
    files.export_tagged(path, nation=read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), region=read(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


@query(values([("nested to csv", True), ("write to a source", True), ("estimate over the limit", True), ("wall clock for an instant", True), ("unknown model", True), ("plain to csv", False)], "what", "refused"))
def io_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, g = read(spark, sf_dir, "nation"), graph(spark, sf_dir)
    clocks = new_folder(spark, "clocks")
    read(spark, sf_dir, "orders").limit(1).select("o_orderdate").write.parquet(clocks)
    rows = [
        ("nested to csv", refused(lambda: nation.select(F.array("n_name").alias("a")).write.csv(new_folder(spark, "nested")))),
        ("write to a source", refused(lambda: g.source.write(nation))),
        ("estimate over the limit", refused(lambda: files.guarded(nation, 1))),
        ("wall clock for an instant", refused(lambda: files.land(spark, clocks, "never", ("o_orderdate",)))),
        ("unknown model", refused(lambda: g["no_such_model"])),
        ("plain to csv", refused(lambda: nation.write.csv(new_folder(spark, "plain")))),
    ]
    return constant(spark, rows, "what string, refused boolean")


@query("SELECT o_orderkey, epoch_us(o_orderdate)::BIGINT AS micros FROM orders")
def io_landed_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall clocks made instants, landed as a table with counts checked; no microsecond may move."""
    out, moved = files.as_instants(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    if not moved.isEmpty():
        raise RuntimeError("instants have moved")
    path, name, copy = new_folder(spark, "landing"), f"sparkmart_{uuid.uuid4().hex}", new_folder(spark, "landed")
    out.write.parquet(path)
    files.land(spark, path, name, ("o_orderdate",))
    spark.table(name).select("o_orderkey", F.unix_micros("o_orderdate").alias("micros")).write.parquet(copy)
    files.drop_table(spark, name)
    return spark.read.parquet(copy)


_VOLUMES = [("distribution_centers", 10), ("events", 20000), ("inventory_items", 10000), ("order_items", 8000), ("orders", 3000), ("products", 200), ("users", 400)]


@query(values([(t, n, True) for t, n in _VOLUMES], "relation", "n", "schema_kept"))
def io_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test shop as Parquet: volumes, and whether each table keeps its declared schema, geometry as text."""
    out = None
    for n, path in measure.to_folder(fixture.shop(spark), new_folder(spark, "shop")).items():
        df = spark.read.parquet(path)
        one = df.agg(F.lit(n).alias("relation"), F.count("*").alias("n"), F.lit(not contract(df.schema, schema(n))).alias("schema_kept"))
        out = one if out is None else out.unionByName(one)
    return out


@query(values([("a draw is in [0, 1)", True), ("a draw is repeated by its key", True), ("salts give other draws", True), ("every value is picked", True)], "rule", "ok"))
def fn_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(*(fixture.draw("o_orderkey", s).alias(n) for n, s in (("a", 1), ("b", 1), ("c", 2))), fixture.pick(["x", "y", "z"], "o_orderkey", 3).alias("p"))
    got = rows.agg(F.bool_and((F.col("a") >= 0) & (F.col("a") < 1)).alias("r0"), F.bool_and(F.col("a") == F.col("b")).alias("r1"), F.bool_or(F.col("a") != F.col("c")).alias("r2"), (F.countDistinct("p") == 3).alias("r3"))
    names = ["a draw is in [0, 1)", "a draw is repeated by its key", "salts give other draws", "every value is picked"]
    return got.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("ok")) for i, n in enumerate(names)))))


@query("SELECT s_suppkey, 'POINT(' || s_nationkey || ' ' || s_suppkey || ')' AS point, hex(s_name::BLOB) AS name_hex, 'bigint' AS key_type, 'array<bigint>' AS array_type, 'string' AS point_type, s_acctbal > 5000 AS is_nan FROM supplier")
def fn_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.concat(F.lit("POINT("), F.col("s_nationkey").cast("string"), F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(")")).cast(fn.GEOGRAPHY)
    maybe = F.when(F.col("s_acctbal") > 5000, F.lit(float("nan"))).otherwise(F.col("s_acctbal").cast("double"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", point.alias("point"), F.hex(F.col("s_name").cast("binary")).alias("name_hex"), F.typeof(F.col("s_suppkey").cast(fn.INT)).alias("key_type"), F.typeof(F.array().cast(fn.BIGINT_ARRAY)).alias("array_type"), F.typeof(point).alias("point_type"), F.isnan(maybe).alias("is_nan"))


@query("SELECT p_partkey, regexp_replace(p_name, '^(\\w+) (\\w+)', '\\2 \\1') AS turned FROM part")
def fn_backreference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", r"^(\w+) (\w+)", "$2 $1").alias("turned"))


@query("SELECT event_id, true AS same, false AS other FROM events")
def fn_json_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts compared as parsed: keys turned around and spaced are the same, another number isn't."""
    rows = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"a":1,"b":'), "props", F.lit("}")).alias("x"), F.concat(F.lit('{ "b" : '), "props", F.lit(' , "a":1}')).alias("y"), F.concat(F.lit('{"a":2,"b":'), "props", F.lit("}")).alias("z"))
    return rows.select("event_id", ev.json_equal(F.col("x"), F.col("y")).alias("same"), ev.json_equal(F.col("x"), F.col("z")).alias("other"))


@query("SELECT n_regionkey, r_name FROM (SELECT n_regionkey, any_value(r_name) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey)")
def a_any_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("n_regionkey").agg(F.any_value("r_name").alias("r_name"))


@query("SELECT event_type, date_trunc('month', ts)::TIMESTAMP AS month, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def a_group_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT event_type, date_trunc('month', ts)::timestamp_ntz AS month, count(*) AS n FROM {events} GROUP BY 1, 2", events=read(spark, sf_dir, "events"))


@query("SELECT c_nationkey, md5(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey)) AS sequence_md5 FROM customer GROUP BY 1")
def a_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of each group's keys in order."""
    return spark.sql("SELECT c_nationkey, md5(listagg(cast(c_custkey AS string), ',') WITHIN GROUP (ORDER BY c_custkey)) AS sequence_md5 FROM {customer} GROUP BY 1", customer=read(spark, sf_dir, "customer"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS partition, count(*)::BIGINT AS n_rows, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def io_partition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.partition_summary(read(spark, sf_dir, "orders").withColumn("month", fn.format_month("o_orderdate")), "month", "o_orderkey")


# verification

_LEFT = "SELECT o_orderkey AS k, o_totalprice::DECIMAL(38,9) AS price, o_orderstatus AS status FROM orders"
_RIGHT = "SELECT k, CASE WHEN k % 40 = 0 THEN price + 0.000000001::DECIMAL(10,9) ELSE price END AS price, CASE WHEN k % 50 = 0 THEN lower(status) ELSE status END AS status FROM l WHERE k % 97 <> 0"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and orders with planted differences: lost rows, a billionth on money, changed texts."""
    left = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), fn.money("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    more = (F.col("price").cast("decimal(28,9)") + F.lit("0.000000001").cast("decimal(10,9)")).cast(fn.MONEY)
    right = left.where("k % 97 <> 0").withColumns({"price": F.when(F.col("k") % 40 == 0, more).otherwise(F.col("price")), "status": F.when(F.col("k") % 50 == 0, F.lower("status")).otherwise(F.col("status"))})
    return left, right


@query(f"""
    WITH l AS ({_LEFT}), r AS ({_RIGHT}), b AS (SELECT l.k, l.price AS a, r.price AS b, l.status AS c, r.status AS d FROM l JOIN r USING (k)),
    x AS (SELECT 'price' AS column_name, k, {_DECIMAL("a")} AS left_text, {_DECIMAL("b")} AS right_text FROM b WHERE a <> b UNION ALL SELECT 'status', k, c, d FROM b WHERE c <> d)
    SELECT column_name, place::INTEGER AS place, k::VARCHAR AS key, left_text, right_text FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY k) AS place FROM x) WHERE place <= 3""")
def v_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.examples(*sides(spark, sf_dir), "k", 3)


@query(f"""
    WITH l AS ({_LEFT}), r AS ({_RIGHT}), rl AS (SELECT k FROM l WHERE k % 30 = 0), rr AS (SELECT k FROM r WHERE k % 70 = 0),
    ll AS (SELECT * FROM l WHERE k NOT IN (SELECT k FROM rl) AND k NOT IN (SELECT k FROM rr)), r2 AS (SELECT * FROM r WHERE k NOT IN (SELECT k FROM rl) AND k NOT IN (SELECT k FROM rr)),
    b AS (SELECT ll.k, r2.k AS rk, ll.price AS a, r2.price AS b, ll.status AS c, r2.status AS d FROM ll LEFT JOIN r2 ON ll.k = r2.k),
    n AS (SELECT (SELECT count(*) FROM rl)::BIGINT AS repeated_left, (SELECT count(*) FROM rr)::BIGINT AS repeated_right)
    SELECT 'price' AS column_name, count(*) FILTER (a = b)::BIGINT AS identical, 0::BIGINT AS equivalent, count(*) FILTER (a <> b)::BIGINT AS different, count(*) FILTER (rk IS NULL)::BIGINT AS only_left, 0::BIGINT AS only_right, (min(k) FILTER (a <> b))::VARCHAR AS example, any_value(repeated_left) AS repeated_left, any_value(repeated_right) AS repeated_right FROM b, n
    UNION ALL SELECT 'status', count(*) FILTER (c = d), 0, count(*) FILTER (c <> d), count(*) FILTER (rk IS NULL), 0, (min(k) FILTER (c <> d))::VARCHAR, any_value(repeated_left), any_value(repeated_right) FROM b, n""")
def v_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed difference of relations some of whose keys repeat: those are counted apart."""
    left, right = sides(spark, sf_dir)
    return ev.row_diff_apart(left.unionByName(left.where("k % 30 = 0")), right.unionByName(right.where("k % 70 = 0")), "k")


@query(f"WITH l AS ({_LEFT}), r AS ({_RIGHT}) SELECT (l.price - r.price)::DECIMAL(38,9) AS delta, count(*)::BIGINT AS n FROM l JOIN r USING (k) WHERE l.price <> r.price GROUP BY 1")
def v_delta_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.delta_histogram(*sides(spark, sf_dir), "k", "price")


@query(f"WITH l AS ({_LEFT}), r AS ({_RIGHT}), f AS (SELECT k FROM l ORDER BY k LIMIT 100) SELECT k, 'status' AS column_name, l.status AS l, r.status AS r FROM l JOIN r USING (k) JOIN f USING (k) WHERE l.status <> r.status UNION ALL SELECT k, 'status', l.status, NULL FROM l JOIN f USING (k) WHERE k NOT IN (SELECT k FROM r)")
def v_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the first hundred keys' cells print where they differ."""
    left, right = sides(spark, sf_dir)
    return verify.rendered(left.drop("price"), right.drop("price"), "k", 100)


@query(values([("price: digest",), ("price: n_distinct",), ("price: n_rows",), ("status: digest",), ("status: n_distinct",), ("status: n_rows",), ("k: digest",), ("k: n_distinct",), ("k: n_rows",)], "difference"))
def v_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells the two sides apart; a side doesn't differ from itself."""
    left, right = sides(spark, sf_dir)
    if not verify.verdict(left, left.orderBy("status")).same:
        raise RuntimeError("a relation differs from itself")
    return constant(spark, [(x,) for x in verify.verdict(left, right).differences], "difference string")


@query("SELECT n AS name, ('0x' || md5(n)[1:8])::BIGINT AS digest FROM (VALUES ('a'), ('é'), ('12.3'), ('<null>')) t(n)")
def v_digest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of constants, before it is believed of relations."""
    rows = constant(spark, [("a",), ("é",), ("12.3",), ("<null>",)], "name string")
    return rows.groupBy("name").agg(verify.digest(F.col("name")).alias("digest"))


@query(values([("a", "int"), ("b", "decimal"), ("c", "array<int>"), ("d", "struct<x:int,y:array<string>>"), ("e", "timestamp"), ("f", "bytes"), ("g", "float"), ("h", "date"), ("i", "bool"), ("j", "string")], "column_name", "kind"))
def v_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.StructType.fromDDL("a int, b decimal(12,3), c array<smallint>, d struct<x:long,y:array<string>>, e timestamp_ntz, f binary, g float, h date, i boolean, j string")
    return constant(spark, [(f.name, verify.kind(f.dataType)) for f in found], "column_name string, kind string")


@query("SELECT x AS column_name, true AS same FROM (VALUES ('order_id'), ('order_status'), ('gross_revenue')) t(x)")
def v_profile_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of a fact and of its copy in other types, value by value."""
    rows = graph(spark, sf_dir)["fct_orders"].select("order_id", "order_status", "gross_revenue")
    a, b = ({r["column_name"]: r.asDict() for r in verify.profile(x).collect()} for x in (rows, rows.withColumn("gross_revenue", F.col("gross_revenue").cast("decimal(30,9)"))))
    return constant(spark, [(n, all(verify.close(str(a[n][k]), str(b[n][k])) for k in a[n])) for n in a], "column_name string, same boolean")


@query(values([("missing: cost",), ("type: id is string, declared bigint",), ("undeclared: colour",)], "broken"))
def v_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a planted schema breaks; the sources at hand must break nothing, and every model must bind."""
    if contracts.broken_sources(from_driver_tables(spark, sf_dir)) or contracts.unbound_models(spark):
        raise RuntimeError("the contract is broken")
    found = T.StructType([T.StructField(f.name, T.StringType() if f.name == "id" else f.dataType) for f in schema("products") if f.name != "cost"])
    return constant(spark, [(x,) for x in contract(found, schema("products"), [*SCHEMAS["products"].replace(" bigint", "").replace(" double", "").replace(" string", "").split(", "), "colour"])], "broken string")


@query(values([("staging", 7, 0), ("intermediate", 11, 0), ("mart", 12, 0)], "layer", "models", "findings"))
def v_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts.lint()
    return constant(spark, [(layer, sum(m.layer == layer for m in MODELS.values()), len(found)) for layer in ("staging", "intermediate", "mart")], "layer string, models long, findings long")


@query(values([(n,) for n in ("all_but", "date_series", "day_of_week_iso", "days_between", "decimal_type", "format_date", "format_month", "int_series", "json_value", "matches", "minus", "money", "month_number", "month_start", "physical_layout", "quotient", "round_money", "safe_cast", "safe_divide", "seconds_between", "struct_of", "surrogate_key", "to_text", "to_utc", "trunc_to", "unnest")], "function"))
def v_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constant(spark, [(x.split("(")[0],) for x in contracts.function_listing()], "function string")


_CASES = [("quotient of thirds", "0.333333333"), ("half away from zero", "-0.500000000"), ("by zero", None), ("iso day of a Sunday", "7"), ("month", "2024-02"), ("key without nulls", "df6729622b8fb993f31b1ba95a27e5cc"), ("series down", "5,3,1"), ("json null", '{"a":null}'), ("no number", None)]


@query(values(_CASES, "case_name", "value"))
def v_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants through the functions."""
    m = lambda x: F.lit(x).cast(fn.MONEY)
    day = lambda x: F.lit(x).cast("date")
    got = [fn.quotient(m("1"), F.lit(3)), fn.quotient(m("-1"), F.lit(2)), fn.quotient(m("1"), F.lit(0)), fn.day_of_week_iso(day("2024-03-03")), fn.format_month(day("2024-02-29")), fn.surrogate_key(F.lit(1), F.lit(None), F.lit("x")), F.array_join(F.transform(fn.int_series(5, 1, -2), lambda x: x.cast("string")), ","), fn.json_value(fn.struct_of(("a", None, fn.INT))), fn.safe_cast(F.lit("x"), fn.INT)]
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(n).alias("case_name"), c.cast("string").alias("value")) for (n, _), c in zip(_CASES, got)))))


@query("SELECT x AS column_name, (SELECT count(*) FROM lineitem)::BIGINT AS n_rows, true AS same FROM (VALUES ('l_orderkey'), ('price'), ('ship'), ('ratio'), ('pair')) t(x)")
def v_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every kind, written and read again, agree in digests and distinct values."""
    path = new_folder(spark, "reload")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", fn.money("l_extendedprice").alias("price"), F.col("l_shipdate").alias("ship"), (F.col("l_tax") / 7).alias("ratio"), F.struct("l_returnflag", "l_linenumber").alias("pair"))
    files.export(rows, path, shards=4)
    a, b = verify.metrics(rows), verify.metrics(spark.read.parquet(path)).select(F.col("column_name").alias("c"), F.col("digest").alias("d"), F.col("n_distinct").alias("u"))
    return a.join(b, F.col("column_name") == F.col("c")).select("column_name", "n_rows", ((F.col("digest") == F.col("d")) & (F.col("n_distinct") == F.col("u"))).alias("same"))


@query(values([("error", "has rows", 25, False, False), ("warn", "has rows", 25, True, True), ("error", "has none", 0, True, False), ("warn", "has none", 0, True, False)], "severity", "test", "violations", "passed", "warned"))
def dq_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    tests = [dt.Test(n, lambda c=c: nation.where(c), s) for n, c in (("has rows", "true"), ("has none", "false")) for s in ("error", "warn")]
    return constant(spark, [(t.severity, *(t.run()[k] for k in ("test", "violations", "passed", "warned"))) for t in tests], "severity string, test string, violations long, passed boolean, warned boolean")


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in cents, with nine decimals, and of another engine: a billionth more, or lost, for some."""
    x = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 1.07 + F.col("p_partkey") / F.lit(3000.0)).cast("decimal(38,9)").alias("price"))
    narrow = F.col("price").cast("decimal(30,9)")
    other = F.when(F.col("p_partkey") % 10 == 0, narrow + F.lit("0.000000001").cast("decimal(10,9)")).when(F.col("p_partkey") % 77 == 0, F.lit(0)).otherwise(narrow)
    return ev.attributed(x.withColumn("price", F.round("price", 2)), x, x.withColumn("price", other.cast("decimal(38,9)")), "p_partkey", "price")


_LEGS = f"x AS ({_PRICES}), t AS (SELECT p_partkey, round(price::DECIMAL(38,9), 2)::DECIMAL(38,9) AS base, price::DECIMAL(38,9) AS wide, CASE WHEN p_partkey % 10 = 0 THEN price::DECIMAL(38,9) + 0.000000001::DECIMAL(10,9) WHEN p_partkey % 77 = 0 THEN 0 ELSE price::DECIMAL(38,9) END::DECIMAL(38,9) AS other FROM x), b AS (SELECT *, CASE WHEN base = other THEN 'identical' WHEN wide = other THEN 'A' WHEN abs(wide - other) < 0.01 THEN 'B' ELSE 'C' END AS bucket FROM t)"


@query(f"WITH {_LEGS} SELECT bucket, place::INTEGER AS place, p_partkey AS key FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY p_partkey) AS place FROM b) WHERE place <= 3")
def v_attribution_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.first_k(legs(spark, sf_dir), "bucket", 3, "key").select("bucket", "place", "key")


@query(values([("every row has a bucket", 0), ("every key has all three legs", 0), ("the base leg holds whole cents", 0), ("the wide leg rounds to the base", 0), ("an A row differs by less than a cent", 0)], "invariant", "violations"))
def v_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.invariants(legs(spark, sf_dir))


@query(f"WITH {_LEGS} SELECT 'wide' AS agrees_with, count(*)::BIGINT AS n FROM b WHERE bucket = 'C' HAVING count(*) > 0")
def v_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that no scale explains, recomputed from the raw prices."""
    return ev.lineage(legs(spark, sf_dir), read(spark, sf_dir, "part"), "p_partkey", F.col("p_retailprice") * 1.07 + F.col("p_partkey") / F.lit(3000.0))


@query("SELECT x AS column_name, true AS same FROM (VALUES ('revenue_date'), ('order_count'), ('order_item_count'), ('customer_count'), ('gross_revenue'), ('total_cost'), ('gross_margin'), ('average_order_value'), ('returned_item_count')) t(x)")
def v_determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.repeated_builds(lambda: graph(spark, sf_dir)["mart_daily_revenue"])


@query(values([("extended", False, True), ("price", True, True)], "column_name", "same", "same_rounded"))
def v_scale_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds of lines, cents and nine decimals: which columns scale alone keeps apart."""
    rows = read(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice").cast("decimal(30,9)"), 2).alias("price"), (F.col("l_extendedprice").cast("decimal(18,2)") / 3).cast("decimal(30,9)").alias("extended"))
    return ev.scale_columns(rows.withColumn("extended", F.round("extended", 2)), rows)


@query("SELECT * FROM (VALUES ('order_items', 'sale_price', false), ('products', 'cost', true), ('products', 'retail_price', true)) t(relation, column_name, ok)")
def v_source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was recorded of the sources' money, stored, against the sources with one item lost."""
    source, money, path = from_driver_tables(spark, sf_dir), {"products": ["cost", "retail_price"], "order_items": ["sale_price"]}, new_folder(spark, "recorded")
    tables = {n: source.table(n) for n in money}
    ev.recorded(tables, money).write.parquet(path)
    first = tables["order_items"].agg(F.min("id")).first()[0]
    return ev.source_gate(spark.read.parquet(path), ev.recorded(tables | {"order_items": tables["order_items"].where(F.col("id") != first)}, money))


@query("SELECT l_orderkey, l_linenumber, true AS price, true AS ratio, true AS ship, true AS flag, false AS moved FROM lineitem")
def v_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two renderings, equal as their kind has it; a moved microsecond isn't."""
    c = F.col
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", ev.tolerant(c("l_extendedprice").cast("decimal(18,2)"), c("l_extendedprice").cast("decimal(18,2)").cast("decimal(38,9)"), T.DecimalType(18, 2)).alias("price"),
        ev.tolerant(c("l_tax") / 7, c("l_tax") / 7 * (1 + 1e-13), T.DoubleType()).alias("ratio"), ev.tolerant(c("l_shipdate"), c("l_shipdate").cast("timestamp"), T.TimestampNTZType()).alias("ship"),
        ev.tolerant(c("l_returnflag").cast("binary"), F.lower(F.hex("l_returnflag")), T.BinaryType()).alias("flag"), ev.tolerant(c("l_shipdate"), c("l_shipdate") + F.expr("interval 1 microsecond"), T.TimestampNTZType()).alias("moved"),
    )


@query("SELECT * FROM (VALUES ('6.644999999552965', 6.64::DECIMAL(18,2), 6.65::DECIMAL(18,2))) t(x, at_once, by_way)")
def v_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles whose cents depend on a step by way of nine decimals."""
    rows = constant(spark, [(6.644999999552965,), (1.0,), (2.345,), (None,)], "x double")
    return verify.two_step_rounding(rows, "x").withColumn("x", F.col("x").cast("string"))


@query(values([("n_nationkey", 0), ("n_name", 0)], "column_name", "n_rows"))
def io_schema_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's columns, from a run of it that gives no row."""
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").limit(0)
    n = rows.count()
    return files.columns_of(rows).select("column_name", F.lit(n).cast("long").alias("n_rows"))
