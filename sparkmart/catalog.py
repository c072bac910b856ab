"""All queries of the library by name, and DuckDB's SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from .operators import data_tests as dt
from .operators import verify
from .plans import MODELS, Graph
from .plans.intermediate import gap_sessions
from .plans.sql import MODELS as MODEL_SQL
from .plans.sql import quotient, with_models
from .sources import files, from_driver_tables, measure
from .sources.landed import landed
from .sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The models over the shop's source tables, which are landed as Parquet before a model reads them for the first time."""
    return Graph(landed(spark, sf_dir), spark)


def query(sql: str | None = None):
    """Registers a function as a query, with SQL that may name models and source tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_models(sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for _name in MODELS:
    if _name in MODEL_SQL:
        QUERIES[_name] = lambda spark, sf_dir, n=_name: graph(spark, sf_dir)[n]
        SQL[_name] = with_models(f"SELECT * FROM {_name}")


@query("SELECT 1::BIGINT AS id, '1,2,3' AS int_array, '2024-03-01,2024-03-02,2024-03-03' AS date_array, 1::BIGINT AS pair_id, 'web' AS pair_channel, '{\"id\":1,\"channel\":\"web\"}' AS pair_json")
def mart_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of nested values, its arrays and struct as plain columns."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return Graph(from_driver_tables(spark, sf_dir), spark)["mart_types"].select("id", text("int_array"), text("date_array"), F.col("pair_struct.id").alias("pair_id"), F.col("pair_struct.channel").alias("pair_channel"), "pair_json")


@query("""
    WITH e AS (SELECT user_id, created_at, event_id, event_type, lag(created_at) OVER w AS before FROM stg_events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY created_at, event_id)),
    n AS (SELECT *, sum(CASE WHEN before IS NULL OR date_diff('microsecond', before, created_at) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_number FROM e)
    SELECT user_id, session_number, min(created_at) AS first_event_at, max(created_at) AS last_event_at, count(*)::BIGINT AS event_count, bool_or(event_type = 'purchase') AS has_purchase FROM n GROUP BY ALL""")
def int_events_sessions_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_sessions(graph(spark, sf_dir)["stg_events"])


# functions on real columns


@query("""
    SELECT o_orderkey, TRY_CAST(o_orderpriority[1:1] AS BIGINT) AS priority, TRY_CAST(o_orderstatus AS BIGINT) AS no_number, o_orderkey::VARCHAR AS key_text, o_orderdate AS ordered_at,
      o_totalprice::DECIMAL(18,2) AS total_cents, o_totalprice::DECIMAL(38,9) AS total FROM orders""")
def fn_casting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", fn.safe_cast(F.substring("o_orderpriority", 1, 1), fn.INT).alias("priority"), fn.safe_cast("o_orderstatus", fn.INT).alias("no_number"), fn.to_text("o_orderkey").alias("key_text"),
        fn.to_utc("o_orderdate").alias("ordered_at"), F.col("o_totalprice").cast(fn.decimal_type(18, 2)).alias("total_cents"), fn.money("o_totalprice").alias("total"),
    )


@query("""
    SELECT event_id, date_diff('day', DATE '2020-01-01', ts::DATE)::BIGINT AS days, strftime(ts, '%Y/%m/%d') AS slashed, strftime(ts, '%j') AS day_of_year, strftime(ts, '%a %b') AS names, strftime(ts, '%Y-%m') AS month,
      date_trunc('hour', ts)::TIMESTAMP AS hour, date_trunc('week', ts)::TIMESTAMP AS week, date_trunc('quarter', ts)::TIMESTAMP AS quarter, isodow(ts)::BIGINT AS dow, date_trunc('month', ts)::TIMESTAMP AS month_at,
      (year(ts) * 100 + month(ts))::BIGINT AS yyyymm, date_diff('microsecond', TIMESTAMP '2020-01-01 00:00:00', ts) / 1000000.0::DOUBLE AS seconds FROM events""")
def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2020-01-01").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").select(
        "event_id", fn.days_between("ts", start).alias("days"), fn.format_date("ts", "%Y/%m/%d").alias("slashed"), fn.format_date("ts", "%j").alias("day_of_year"), fn.format_date("ts", "%a %b").alias("names"),
        fn.format_month("ts").alias("month"), fn.trunc_to("ts", "hour").alias("hour"), fn.trunc_to("ts", "week").alias("week"), fn.trunc_to("ts", "quarter").alias("quarter"), fn.day_of_week_iso("ts").alias("dow"),
        fn.month_start("ts").alias("month_at"), fn.month_number("ts").alias("yyyymm"), fn.seconds_between(start, "ts").alias("seconds"),
    )


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, m AS amount, {quotient("m", "k")} AS per_line, round({quotient("m", "k")}, 2)::DECIMAL(38,9) AS cents, {quotient("-m", "k")} AS negative,
      l_tax / nullif(l_discount, 0) AS ratio, (m - d)::DECIMAL(38,9) AS less
    FROM (SELECT *, l_extendedprice::DECIMAL(38,9) AS m, l_discount::DECIMAL(38,9) AS d, l_linenumber - 1 AS k FROM lineitem)""")
def fn_math_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumns({"m": fn.money("l_extendedprice"), "k": F.col("l_linenumber") - 1})
    each = fn.quotient("m", "k")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("m").alias("amount"), each.alias("per_line"), fn.round_money(each).alias("cents"), fn.quotient(-F.col("m"), "k").alias("negative"), fn.safe_divide("l_tax", "l_discount").alias("ratio"), fn.minus("m", "l_discount").alias("less"))


@query("""
    SELECT p_partkey, array_to_string(generate_series(1, p_size % 5), ',') AS up, array_to_string(generate_series(1, 9, 3), ',') AS by_three, len(generate_series(5, p_size % 4))::INTEGER AS none,
      array_to_string(list_transform(generate_series(DATE '2024-01-01', DATE '2024-01-01' + (p_size % 3)::INTEGER, INTERVAL 1 DAY), lambda x: strftime(x, '%Y-%m-%d')), ',') AS days FROM part""")
def fn_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.lit("2024-01-01").cast("date")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return read(spark, sf_dir, "part").select("p_partkey", text(fn.int_series(1, F.col("p_size") % 5)).alias("up"), text(fn.int_series(1, 9, 3)).alias("by_three"), F.size(fn.int_series(5, F.col("p_size") % 4)).alias("none"), text(fn.date_series(first, F.date_add(first, F.col("p_size") % 3))).alias("days"))


@query("""
    SELECT r_regionkey, '{"id":' || r_regionkey || ',"name":"' || r_name || '","none":null}' AS pair, r_name AS name, r_regionkey + i AS element FROM region, range(1, 3) t(i)""")
def fn_structs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = fn.struct_of(("id", F.col("r_regionkey"), fn.INT), ("name", F.col("r_name"), fn.STRING), ("none", F.lit(None), fn.STRING))
    rows = read(spark, sf_dir, "region").withColumn("s", one)
    return rows.select("r_regionkey", fn.json_value("s").alias("pair"), F.col("s.name").alias("name"), fn.unnest(fn.int_series(1, 2), "i")).withColumn("element", F.col("r_regionkey") + F.col("i")).drop("i")


@query("SELECT c_custkey, md5(c_custkey || '||' || c_mktsegment) AS key, regexp_matches(c_mktsegment, '^B') AS begins, regexp_matches(c_name, '[0-9]+$') AS ends, md5('1||x') AS fixed FROM customer")
def fn_keys_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", fn.surrogate_key("c_custkey", "c_mktsegment").alias("key"), fn.matches("c_mktsegment", "^B").alias("begins"), fn.matches("c_name", "[0-9]+$").alias("ends"), fn.surrogate_key(F.lit(1), F.lit("x")).alias("fixed"))


@query("SELECT * EXCLUDE (p_retailprice, p_size) REPLACE (upper(p_brand) AS p_brand) FROM part")
def sel_except_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.all_but(read(spark, sf_dir, "part"), "p_retailprice", "p_size").withColumns({"p_brand": F.upper("p_brand")})


@query("SELECT product_id, gross_revenue FROM mart_product_performance ORDER BY (units_sold > 30) DESC, gross_revenue DESC, product_id LIMIT 10")
def topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph(spark, sf_dir)["mart_product_performance"]
    return rows.orderBy(F.desc(F.col("units_sold") > 30), F.desc("gross_revenue"), "product_id").limit(10).select("product_id", "gross_revenue")


@query("SELECT o_orderpriority, min(o_totalprice)::DECIMAL(38,9) AS least FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_totalprice BETWEEN 1000 AND 400000 GROUP BY 1 ORDER BY least, 1 LIMIT 3")
def topk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1997-01-01' and o_totalprice between 1000 and 400000")
    return rows.groupBy("o_orderpriority").agg(fn.money(F.min("o_totalprice")).alias("least")).orderBy("least", "o_orderpriority").limit(3)


# data tests


@query("SELECT order_item_id AS value, count(*)::BIGINT AS n FROM stg_order_items WHERE order_item_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.unique(graph(spark, sf_dir)["stg_order_items"], "order_item_id")


@query("SELECT inventory_item_id, product_id FROM stg_inventory WHERE sold_at IS NULL")
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.not_null(graph(spark, sf_dir)["stg_inventory"], "sold_at").select("inventory_item_id", "product_id")


@query("SELECT event_type AS value, count(*)::BIGINT AS n FROM stg_events GROUP BY 1 HAVING event_type NOT IN ('view', 'click', 'purchase')")
def dq_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.accepted_values(graph(spark, sf_dir)["stg_events"], "event_type", ["view", "click", "purchase"])


@query("SELECT event_id, user_id FROM stg_events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM stg_orders)")
def dq_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return dt.relationships(g["stg_events"], "user_id", g["stg_orders"], "user_id").select("event_id", "user_id")


@query("""
    SELECT i.order_item_id, i.order_id, i.user_id, i.product_id, o.order_id IS NULL AS missing_order, u.user_id IS NULL AS missing_user, p.product_id IS NULL AS missing_product, o.user_id AS order_user_id
    FROM stg_order_items i LEFT JOIN stg_orders o ON o.order_id = i.order_id LEFT JOIN stg_users u ON u.user_id = i.user_id LEFT JOIN (SELECT * FROM stg_products WHERE product_id % 50 <> 0) p ON p.product_id = i.product_id
    WHERE o.order_id IS NULL OR u.user_id IS NULL OR p.product_id IS NULL OR o.user_id <> i.user_id""")
def dq_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every fiftieth product taken away, as the tables have no orphans."""
    g = graph(spark, sf_dir)
    return dt.orphan_items(g["stg_order_items"], g["stg_orders"], g["stg_users"], g["stg_products"].where("product_id % 50 <> 0"))


@query("""
    SELECT o.order_id, num_of_item, coalesce(n, 0)::BIGINT AS order_item_count, f.item_count AS fct_item_count
    FROM stg_orders o LEFT JOIN (SELECT order_id, count(*) AS n FROM stg_order_items GROUP BY 1) USING (order_id) LEFT JOIN fct_orders f USING (order_id)
    WHERE num_of_item IS NULL OR num_of_item <> coalesce(n, 0) OR f.item_count IS NULL OR f.item_count <> coalesce(n, 0)""")
def dq_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return dt.item_counts(g["stg_orders"], g["stg_order_items"], g["fct_orders"])


@query("""
    SELECT 'orders' AS record_type, order_id AS record_id FROM stg_orders WHERE shipped_at > delivered_at OR shipped_at > returned_at OR delivered_at > returned_at OR created_at > shipped_at OR created_at > delivered_at OR created_at > returned_at
    UNION ALL SELECT 'order_items', order_item_id FROM stg_order_items WHERE shipped_at > delivered_at OR shipped_at > returned_at OR delivered_at > returned_at""")
def dq_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return dt.lifecycle(g["stg_orders"], g["stg_order_items"])


@query("""
    SELECT 'order_item_created_after_lifecycle' AS record_type, order_item_id AS record_id FROM stg_order_items WHERE created_at > shipped_at OR created_at > delivered_at OR created_at > returned_at
    UNION ALL SELECT 'order_item_created_before_order', order_item_id FROM stg_order_items i JOIN stg_orders o USING (order_id) WHERE i.created_at < o.created_at""")
def dq_plausible_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return dt.plausible(g["stg_orders"], g["stg_order_items"])


_SENT = "created_at > shipped_at OR shipped_at > delivered_at OR delivered_at > returned_at"
_SOURCE_SQL = {
    "order_items without order": "src_order_items WHERE order_id NOT IN (SELECT order_id FROM src_orders)",
    "order_items without user": "src_order_items i LEFT JOIN src_users u ON u.id = i.user_id WHERE u.id IS NULL",
    "order_items without product": "src_order_items WHERE product_id NOT IN (SELECT id FROM src_products)",
    "order_items without unit": "src_order_items WHERE inventory_item_id NOT IN (SELECT id FROM src_inventory_items)",
    "orders without user": "src_orders WHERE user_id NOT IN (SELECT id FROM src_users)",
    "units without product": "src_inventory_items WHERE product_id NOT IN (SELECT id FROM src_products)",
    "products without center": "src_products WHERE distribution_center_id NOT IN (SELECT id FROM src_distribution_centers)",
    "events without user": "src_events e LEFT JOIN src_users u ON u.id = e.user_id WHERE u.id IS NULL",
    "item of another user than its order": "src_order_items i JOIN src_orders o USING (order_id) WHERE i.user_id <> o.user_id",
    "declared items are not those counted": "src_orders o LEFT JOIN (SELECT order_id, count(*) AS n FROM src_order_items GROUP BY 1) USING (order_id) WHERE num_of_item <> coalesce(n, 0)",
    "item of another product than its unit": "src_order_items i JOIN src_inventory_items u ON u.id = i.inventory_item_id WHERE i.product_id <> u.product_id",
    "item before its order": "src_order_items i JOIN src_orders o USING (order_id) WHERE o.created_at > i.created_at",
    "orders out of time order": f"src_orders WHERE {_SENT}",
    "order_items out of time order": f"src_order_items WHERE {_SENT}",
    "returned without a time, or the reverse": "(SELECT status, returned_at FROM src_orders UNION ALL SELECT status, returned_at FROM src_order_items) WHERE (status = 'Returned') <> (returned_at IS NOT NULL)",
    "sold unit without item, or the reverse": "src_inventory_items u WHERE (sold_at IS NOT NULL) <> EXISTS (SELECT 1 FROM src_order_items i WHERE i.inventory_item_id = u.id)",
    "unit in several items": "(SELECT inventory_item_id FROM src_order_items GROUP BY 1 HAVING count(*) > 1)",
    "item without a unit's id": "src_order_items WHERE inventory_item_id IS NULL",
    "unit sold before it was there": "src_inventory_items WHERE created_at > sold_at",
    "order not after sign-up": "src_users u JOIN (SELECT user_id, min(created_at) AS f FROM src_orders GROUP BY 1) o ON o.user_id = u.id WHERE u.created_at >= f",
    "price not above zero": "src_order_items WHERE sale_price <= 0",
    "product below cost": "src_products WHERE retail_price < cost",
    "session that doesn't begin at 1": "(SELECT session_id FROM src_events GROUP BY 1 HAVING min(sequence_number) <> 1)",
    "event before sign-up": "src_events e JOIN src_users u ON u.id = e.user_id WHERE e.created_at < u.created_at",
}


def _union(checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k.replace(chr(39), chr(39) * 2)}' AS check_name, (SELECT count(*) FROM {v})::BIGINT AS violations" for k, v in checks.items())


@query(_union(_SOURCE_SQL))
def dq_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.counted(*dt.source_checks(landed(spark, sf_dir).table))


_STAGING_SQL = {
    "items without parents": "stg_order_items i LEFT JOIN stg_orders o ON o.order_id = i.order_id LEFT JOIN stg_users u ON u.user_id = i.user_id LEFT JOIN stg_products p ON p.product_id = i.product_id LEFT JOIN stg_inventory n ON n.inventory_item_id = i.inventory_item_id WHERE o.order_id IS NULL OR u.user_id IS NULL OR p.product_id IS NULL OR n.inventory_item_id IS NULL",
    "orders without user": "stg_orders WHERE user_id NOT IN (SELECT user_id FROM stg_users)",
    "events without user": "stg_events e LEFT JOIN stg_users u USING (user_id) WHERE u.user_id IS NULL",
    "units without product or center": "stg_inventory u LEFT JOIN stg_products p USING (product_id) LEFT JOIN stg_centers c ON c.distribution_center_id = u.distribution_center_id WHERE p.product_id IS NULL OR c.distribution_center_id IS NULL",
    "declared items are not those counted": "stg_orders o LEFT JOIN (SELECT order_id, count(*) AS n FROM stg_order_items GROUP BY 1) USING (order_id) WHERE num_of_item <> coalesce(n, 0)",
    "item before its order": "stg_order_items i JOIN stg_orders o USING (order_id) WHERE i.created_at < o.created_at",
    "items out of time order": "stg_order_items WHERE shipped_at < created_at OR delivered_at < shipped_at OR returned_at < delivered_at",
    "unit sold before it was there": "stg_inventory WHERE sold_at < created_at",
    "unit in another center than its product": "stg_inventory u JOIN stg_products p USING (product_id) WHERE u.distribution_center_id <> p.distribution_center_id",
    "declared items of all orders are not all items": "(SELECT 1 WHERE (SELECT sum(num_of_item) FROM stg_orders) <> (SELECT count(*) FROM stg_order_items))",
}


@query(_union(_STAGING_SQL))
def dq_staging_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.counted(*dt.staging_checks(graph(spark, sf_dir)))


_GRAINS = [
    ("int_order_items_enriched", "order_item_id"), ("int_orders_item_rollup", "order_id"), ("int_orders_daily", "order_date"), ("int_users_lifetime_orders", "user_id"), ("int_users_first_order_cohort", "user_id"),
    ("int_cohorts_user_months", "user_month_key"), ("int_cohorts_user_months", "user_id", "activity_month"), ("int_products_sales", "product_id"), ("int_products_returns", "product_id"), ("int_inventory_enriched", "inventory_item_id"),
    ("int_inventory_by_product_center", "product_center_key"), ("int_inventory_by_product_center", "product_id", "distribution_center_id"), ("int_events_sessions", "session_id"),
]


def _grain_sql(name: str, *key: str) -> str:
    one = f"({', '.join(key)})" if len(key) > 1 else key[0]
    null = " OR ".join(f"{k} IS NULL" for k in key)
    inner = f"SELECT count(*)::BIGINT AS n_rows, count(DISTINCT {one})::BIGINT AS n_keys, count(*) FILTER ({null})::BIGINT AS null_keys FROM {name}"
    return f"SELECT '{name}' AS relation, '{', '.join(key)}' AS key, *, n_rows = n_keys AND null_keys = 0 AS grain_ok FROM ({inner})"


@query(" UNION ALL ".join(_grain_sql(*g) for g in _GRAINS))
def dq_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    rows = [dt.grain(n, g[n], *k) for n, *k in _GRAINS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("""
    SELECT 'items of orders are all items' AS check_name, (SELECT sum(item_count) FROM int_orders_item_rollup) = (SELECT count(*) FROM stg_order_items) AS ok
    UNION ALL SELECT 'a unit is in one item', (SELECT count(DISTINCT inventory_item_id) FROM int_order_items_enriched) = (SELECT count(*) FROM stg_order_items)
    UNION ALL SELECT 'revenue is the same everywhere', (SELECT sum(sale_price) FROM stg_order_items) = (SELECT sum(gross_revenue) FROM int_orders_daily) AND (SELECT sum(sale_price) FROM stg_order_items) = (SELECT sum(lifetime_gross_revenue) FROM int_users_lifetime_orders)
      AND (SELECT sum(sale_price) FROM stg_order_items) = (SELECT sum(gross_revenue) FROM int_products_sales) AND (SELECT sum(sale_price) FROM stg_order_items) = (SELECT sum(revenue) FROM int_cohorts_user_months)
    UNION ALL SELECT 'units are sold or open', (SELECT sum(inventory_units) = sum(sold_units) + sum(open_units) AND sum(inventory_units) = (SELECT count(*) FROM stg_inventory) FROM int_inventory_by_product_center)
    UNION ALL SELECT 'sessions hold all events', (SELECT sum(event_count) FROM int_events_sessions) = (SELECT count(*) FROM stg_events)
    UNION ALL SELECT 'return rates are shares', (SELECT coalesce(bool_and(return_rate BETWEEN 0 AND 1), true) FROM int_products_returns)
    UNION ALL SELECT 'days to sell', (SELECT bool_and((days_to_sell IS NULL) = (NOT is_sold) AND coalesce(days_to_sell, 0) >= 0) FROM int_inventory_enriched)
    UNION ALL SELECT 'cohorts begin months', (SELECT bool_and(cohort_month <= activity_month AND day(activity_month) = 1 AND day(cohort_month) = 1) FROM int_cohorts_user_months)
    UNION ALL SELECT 'keys of user months', (SELECT bool_and(user_month_key = md5(user_id || '||' || strftime(activity_month, '%Y%m'))) FROM int_cohorts_user_months)""")
def dq_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.reconciled(graph(spark, sf_dir))


# verification


def _metric_sql(table: str, **columns: tuple[str, str]) -> str:
    one = "SELECT '{n}' AS column_name, '{k}' AS kind, count(*)::BIGINT AS n_rows, (count(*) - count(t))::BIGINT AS n_nulls, coalesce(sum(('0x' || md5(t)[1:8])::BIGINT), 0)::BIGINT AS digest, count(DISTINCT t)::BIGINT AS n_distinct FROM (SELECT {e} AS t FROM {f})"
    return " UNION ALL ".join(one.format(n=n, k=k, e=e, f=table) for n, (k, e) in columns.items())


_DECIMAL = "rtrim(rtrim({0}::VARCHAR, '0'), '.')".format


@query(_metric_sql("mart_daily_revenue", revenue_date=("date", "revenue_date::VARCHAR"), order_count=("int", "order_count::VARCHAR"), gross_revenue=("decimal", _DECIMAL("gross_revenue")), average_order_value=("decimal", _DECIMAL("average_order_value"))))
def v_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.metrics(graph(spark, sf_dir)["mart_daily_revenue"].select("revenue_date", "order_count", "gross_revenue", "average_order_value"))


@query(f"""
    SELECT 'order_id' AS column_name, count(*)::BIGINT AS n_rows, count(order_id)::BIGINT AS n_values, count(DISTINCT order_id)::BIGINT AS n_distinct, sum(order_id)::VARCHAR AS total, min(order_id)::VARCHAR AS low, max(order_id)::VARCHAR AS high FROM fct_orders
    UNION ALL SELECT 'order_status', count(*), count(order_status), count(DISTINCT order_status), sum(length(order_status))::VARCHAR, min(order_status), max(order_status) FROM fct_orders
    UNION ALL SELECT 'gross_revenue', count(*), count(gross_revenue), count(DISTINCT gross_revenue), {_DECIMAL("sum(gross_revenue)")}, {_DECIMAL("min(gross_revenue)")}, {_DECIMAL("max(gross_revenue)")} FROM fct_orders
    UNION ALL SELECT 'is_fully_returned', count(*), count(is_fully_returned), count(DISTINCT is_fully_returned), sum(is_fully_returned::INTEGER)::VARCHAR, NULL, NULL FROM fct_orders""")
def v_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.profile(graph(spark, sf_dir)["fct_orders"].select("order_id", "order_status", "gross_revenue", "is_fully_returned"))


@query("""
    WITH r AS (SELECT order_id AS k, CASE WHEN order_id % 100 = 0 THEN gross_revenue + 0.000000001::DECIMAL(10,9) ELSE gross_revenue END AS gross_revenue, CASE WHEN order_id % 250 = 0 THEN lower(order_status) ELSE order_status END AS order_status
      FROM fct_orders WHERE order_id % 97 <> 0),
    b AS (SELECT l.order_id AS lk, r.k AS rk, l.gross_revenue AS a, r.gross_revenue AS b, l.order_status AS c, r.order_status AS d FROM fct_orders l FULL JOIN r ON l.order_id = r.k)
    SELECT 'gross_revenue' AS column_name, 0::BIGINT AS identical, count(*) FILTER (rk IS NOT NULL AND a = b)::BIGINT AS equivalent, count(*) FILTER (rk IS NOT NULL AND a <> b)::BIGINT AS different, count(*) FILTER (rk IS NULL)::BIGINT AS only_left, 0::BIGINT AS only_right,
      (min(lk) FILTER (rk IS NOT NULL AND a <> b))::VARCHAR AS example FROM b
    UNION ALL SELECT 'order_status', count(*) FILTER (rk IS NOT NULL AND c = d), 0, count(*) FILTER (rk IS NOT NULL AND c <> d), count(*) FILTER (rk IS NULL), 0, (min(lk) FILTER (rk IS NOT NULL AND c <> d))::VARCHAR FROM b""")
def v_row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact against itself with planted differences: lost rows, a billionth on money and another scale, a changed text."""
    left = graph(spark, sf_dir)["fct_orders"].select("order_id", "gross_revenue", "order_status")
    money = F.when(F.col("order_id") % 100 == 0, F.col("gross_revenue").cast("decimal(28,9)") + F.lit("0.000000001").cast("decimal(10,9)")).otherwise(F.col("gross_revenue").cast("decimal(28,9)")).cast("decimal(30,9)")
    right = left.where("order_id % 97 <> 0").select("order_id", money.alias("gross_revenue"), F.when(F.col("order_id") % 250 == 0, F.lower("order_status")).otherwise(F.col("order_status")).alias("order_status"))
    return verify.row_diff(left, right, "order_id")


@query("SELECT 'only left: c_acctbal' AS difference UNION ALL SELECT 'only right: extra' UNION ALL SELECT 'c_nationkey: int and string'")
def v_schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer")
    b = a.drop("c_acctbal").withColumn("c_nationkey", F.col("c_nationkey").cast("string")).withColumn("extra", F.lit(1))
    return spark.createDataFrame([(x,) for x in verify.schema_diff(a.schema, b.schema)], "difference string")


_PRICES = "SELECT p_partkey, p_retailprice * 1.07 + p_partkey / 3000.0::DOUBLE AS price FROM part"


@query(f"""
    WITH x AS ({_PRICES}), t AS (SELECT round(price::DECIMAL(38,9), 2)::DECIMAL(38,9) AS base, price::DECIMAL(38,9) AS wide, CASE WHEN p_partkey % 10 = 0 THEN price::DECIMAL(38,9) + 0.000000001::DECIMAL(10,9) WHEN p_partkey % 77 = 0 THEN 0 ELSE price::DECIMAL(38,9) END::DECIMAL(38,9) AS other FROM x)
    SELECT CASE WHEN base = other THEN 'identical' WHEN wide = other THEN 'A' WHEN abs(wide - other) < 0.01 THEN 'B' ELSE 'C' END AS bucket, count(*)::BIGINT AS n, max(abs(wide - other))::DECIMAL(38,9) AS worst FROM t GROUP BY 1""")
def v_scale_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 1.07 + F.col("p_partkey") / F.lit(3000.0)).cast("decimal(38,9)").alias("price"))
    narrow = F.col("price").cast("decimal(30,9)")
    other = F.when(F.col("p_partkey") % 10 == 0, narrow + F.lit("0.000000001").cast("decimal(10,9)")).when(F.col("p_partkey") % 77 == 0, F.lit(0)).otherwise(narrow)
    return verify.scale_attribution(x.withColumn("price", F.round("price", 2)), x, x.withColumn("price", other.cast("decimal(38,9)")), "p_partkey", "price")


@query(f"""
    SELECT rule, count(*)::BIGINT AS n FROM (
      SELECT CASE WHEN (round({quotient("gross_revenue", "order_count")}, 2) * 100)::BIGINT = floor((gross_revenue * 100)::BIGINT::DOUBLE / 100 / order_count * 100 + 0.5)::BIGINT THEN 'both' ELSE 'exact only' END AS rule FROM int_orders_daily) GROUP BY 1""")
def v_division_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an exact quotient and one by way of doubles give the same cents."""
    rows = graph(spark, sf_dir)["int_orders_daily"]
    exact = (fn.round_money(fn.quotient("gross_revenue", "order_count")).cast("decimal(30,2)") * 100).cast("long")
    revenue = (F.col("gross_revenue").cast("decimal(30,2)") * 100).cast("long").cast("double") / 100
    loose = F.floor(revenue / F.col("order_count") * 100 + 0.5)
    return rows.groupBy(F.when(exact == loose, "both").otherwise("exact only").alias("rule")).agg(F.count("*").alias("n"))


# files


_folder = new_folder


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey END AS n_regionkey, (n_nationkey * 1.5)::DECIMAL(38,9) AS amount FROM nation")
def io_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey")).alias("n_regionkey"), fn.money(F.col("n_nationkey") * 1.5).alias("amount"))
    path = _folder(spark, "csv")
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal::DECIMAL(38,9) AS balance, (s_suppkey % 2 = 0) AS even, '1,' || s_suppkey AS numbers, s_name AS inner_name FROM supplier")
def io_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", fn.money("s_acctbal").alias("balance"), (F.col("s_suppkey") % 2 == 0).alias("even"), F.array(F.lit(1), "s_suppkey").alias("a"), F.struct("s_name").alias("s"))
    path = _folder(spark, "parquet")
    files.export(df, path, shards=3)
    back = files.read_parquet(spark, path, schema=df.schema)
    return back.select("s_suppkey", "s_name", "s_nationkey", "balance", "even", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("numbers"), F.col("s.s_name").alias("inner_name"))


@query("SELECT count(*)::BIGINT AS n, min(inventory_item_id) AS first_id, max(inventory_item_id) AS last_id, sum(unit_cost)::DECIMAL(38,9) AS cost FROM fct_inventory_items WHERE created_at >= TIMESTAMP '1996-03-01' AND created_at < TIMESTAMP '1996-04-01'")
def io_partition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit fact stored by month, then one month of it: one folder is read."""
    path, layout = _folder(spark, "units"), fn.physical_layout()
    layout.write(graph(spark, sf_dir)["fct_inventory_items"], path)
    rows = layout.between(spark.read.parquet(path), "1996-03-01", "1996-04-01")
    return rows.agg(F.count("*").alias("n"), F.min("inventory_item_id").alias("first_id"), F.max("inventory_item_id").alias("last_id"), F.sum("unit_cost").cast(fn.MONEY).alias("cost"))


@query("SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS descents, min(o_orderkey) AS first, max(o_orderkey) AS last, sum(n::HUGEINT * o_orderkey)::VARCHAR AS sequence_sum FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)")
def io_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered export of all orders in files by range: descents within and between files, and a sum of place times key over the whole order."""
    path, orders = _folder(spark, "ordered"), read(spark, sf_dir, "orders").select("o_orderkey")
    rows = measure.numbered(orders, path, "o_orderkey", shards=2 + orders.count() // 1_000_000)
    by_file = files.export_order(spark, path, "o_orderkey").agg(F.sum("n_rows").alias("n_rows"), F.sum("descents").alias("descents"), F.min("first").alias("first"), F.max("last").alias("last"))
    placed = (F.col("row_id").cast("decimal(19,0)") * F.col("o_orderkey").cast("decimal(18,0)")).cast("decimal(38,0)")
    return by_file.crossJoin(F.broadcast(rows.agg(F.sum(placed).cast("string").alias("sequence_sum"))))  # relations of one row


@query("SELECT o_orderpriority, n FROM (SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1) WHERE n IS DISTINCT FROM 0 AND o_orderpriority LIKE '%-%'")
def p_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return rows.where(~F.col("n").eqNullSafe(0) & F.col("o_orderpriority").like("%-%"))


@query("SELECT c_mktsegment, array_to_string(list_sort(list(DISTINCT c_nationkey)), ',') AS nations, count(*) FILTER (c_acctbal < 0)::BIGINT AS in_debt, bool_and(c_acctbal > -1000) AS bounded, count(DISTINCT (c_nationkey, c_mktsegment))::BIGINT AS pairs FROM customer GROUP BY ALL")
def a_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = F.array_join(F.transform(F.array_sort(F.collect_set("c_nationkey")), lambda x: x.cast("string")), ",")
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(nations.alias("nations"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.bool_and(F.col("c_acctbal") > -1000).alias("bounded"), F.countDistinct(F.struct("c_nationkey", "c_mktsegment")).alias("pairs"))


@query("SELECT user_id, event_id, ts, n, n_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS n, count(*) OVER (PARTITION BY user_id, event_type)::BIGINT AS n_type FROM events) WHERE n = 1")
def w_first_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumns({"n": F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")), "n_type": F.count("*").over(Window.partitionBy("user_id", "event_type"))})
    return rows.where("n = 1").select("user_id", "event_id", "ts", "n", "n_type")
