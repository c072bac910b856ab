"""The seven source tables as views of an order-processing star schema.

Lines have no unique key: an item's id is order * 10 + line and may repeat. An inventory unit is one
distinct item id. Users have no sign-up time, and what else the star schema lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import Source, schema


def _shaped(df: DataFrame, table: str, /, **columns: Column | str) -> DataFrame:
    """The declared columns in order; wall-clock times stay as they are, columns not given are null."""
    out = []
    for f in schema(table):
        kind = "timestamp_ntz" if f.dataType.simpleString() == "timestamp" else f.dataType
        c = columns.get(f.name)
        out.append((F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast(kind).alias(f.name))
    return df.select(*out)


def from_driver_tables(spark: SparkSession, folder: str) -> Source:
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    item = F.col("l_orderkey") * 10 + F.col("l_linenumber")

    def centers():
        return _shaped(read("supplier"), "distribution_centers", id="s_suppkey", name="s_name")

    def products():
        return _shaped(read("part"), "products", id="p_partkey", cost="p_retailprice", category="p_type", name="p_name", brand="p_brand", retail_price="p_retailprice", distribution_center_id=F.col("p_partkey") % 10 + 1)

    def users():
        both = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        return _shaped(both, "users", id="c_custkey", first_name="c_name", state="r_name", country="n_name", traffic_source="c_mktsegment")

    def orders():
        declared = read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").alias("n"))
        both = read("orders").join(declared, F.col("o_orderkey") == F.col("k"), "left")
        return _shaped(both, "orders", order_id="o_orderkey", user_id="o_custkey", status="o_orderstatus", created_at="o_orderdate", num_of_item=F.coalesce("n", F.lit(0)))

    def order_items():
        both = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        status = F.when(F.col("l_returnflag") == "R", "Returned").when(F.col("l_returnflag") == "A", "Complete").otherwise("Shipped")
        returned = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))
        return _shaped(both, "order_items", id=item, order_id="l_orderkey", user_id="o_custkey", product_id="l_partkey", inventory_item_id=item, status=status, created_at="o_orderdate", shipped_at="l_shipdate", returned_at=returned, sale_price="l_extendedprice")

    def inventory_items():
        units = read("lineitem").groupBy(item.alias("id")).agg(F.min("l_orderkey").alias("k"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("center"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("sold"))
        both = units.join(read("orders"), F.col("k") == F.col("o_orderkey"), "left").join(read("part"), F.col("part") == F.col("p_partkey"), "left")
        return _shaped(both, "inventory_items", id="id", product_id="part", created_at="o_orderdate", sold_at="sold", cost="p_retailprice", product_category="p_type", product_name="p_name", product_brand="p_brand", product_retail_price="p_retailprice", product_distribution_center_id="center")

    def events():
        session = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
        numbered = read("events").withColumn("session_id", session)
        numbered = numbered.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")))
        return _shaped(numbered, "events", id="event_id", user_id="user_id", sequence_number="n", session_id="session_id", created_at="ts", traffic_source=F.concat(F.lit("k"), F.get_json_object("props", "$.k")), uri="props", event_type="event_type")

    return Source({"distribution_centers": centers, "products": products, "users": users, "orders": orders, "order_items": order_items, "inventory_items": inventory_items, "events": events})


#: The same views in DuckDB's SQL, for comparison.
SQL = {
    "src_distribution_centers": "SELECT s_suppkey AS id, s_name AS name, NULL::DOUBLE AS latitude, NULL::DOUBLE AS longitude FROM supplier",
    "src_products": "SELECT p_partkey AS id, p_retailprice AS cost, p_type AS category, p_name AS name, p_brand AS brand, p_retailprice AS retail_price, NULL::VARCHAR AS department, NULL::VARCHAR AS sku, p_partkey % 10 + 1 AS distribution_center_id FROM part",
    "src_users": "SELECT c_custkey AS id, c_name AS first_name, NULL::VARCHAR AS last_name, NULL::VARCHAR AS email, NULL::BIGINT AS age, NULL::VARCHAR AS gender, r_name AS state, NULL::VARCHAR AS street_address, NULL::VARCHAR AS postal_code, NULL::VARCHAR AS city, n_name AS country, NULL::DOUBLE AS latitude, NULL::DOUBLE AS longitude, c_mktsegment AS traffic_source, NULL::TIMESTAMP AS created_at FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "src_orders": "SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderstatus AS status, NULL::VARCHAR AS gender, o_orderdate AS created_at, NULL::TIMESTAMP AS returned_at, NULL::TIMESTAMP AS shipped_at, NULL::TIMESTAMP AS delivered_at, coalesce(n, 0) AS num_of_item FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS n FROM lineitem GROUP BY 1) ON o_orderkey = k",
    "src_order_items": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, o_custkey AS user_id, l_partkey AS product_id, l_orderkey * 10 + l_linenumber AS inventory_item_id, CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Complete' ELSE 'Shipped' END AS status, o_orderdate AS created_at, l_shipdate AS shipped_at, NULL::TIMESTAMP AS delivered_at, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS returned_at, l_extendedprice AS sale_price FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
    "src_inventory_items": "SELECT u.id, part AS product_id, o_orderdate AS created_at, sold AS sold_at, p_retailprice AS cost, p_type AS product_category, p_name AS product_name, p_brand AS product_brand, p_retailprice AS product_retail_price, NULL::VARCHAR AS product_department, NULL::VARCHAR AS product_sku, center AS product_distribution_center_id FROM (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_orderkey) AS k, min(l_partkey) AS part, min(l_suppkey) AS center, max(CASE WHEN l_linestatus = 'F' THEN l_shipdate END) AS sold FROM lineitem GROUP BY 1) u LEFT JOIN orders ON k = o_orderkey LEFT JOIN part ON part.p_partkey = u.part",
    "src_events": "SELECT event_id AS id, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS sequence_number, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, ts AS created_at, NULL::VARCHAR AS ip_address, NULL::VARCHAR AS city, NULL::VARCHAR AS state, NULL::VARCHAR AS postal_code, NULL::VARCHAR AS browser, 'k' || json_extract_string(props, '$.k') AS traffic_source, props AS uri, event_type FROM events",
}
