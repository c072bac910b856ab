"""Intermediate models. Joins are left joins on a key of the right side, so rows are neither lost nor doubled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import INT, MONEY, minus, money, month_number, month_start, safe_divide, seconds_between, surrogate_key
from . import staging  # noqa: F401  it is declared first
from .registry import model


def _count(c: Column | str) -> Column:
    """A count or a whole number that an outer join may have left null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast(INT)


def _amount(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast(MONEY)).cast(MONEY)


def _one_if(c: Column | str) -> Column:
    return F.when(F.col(c) if isinstance(c, str) else c, 1).otherwise(0)


@model("intermediate", "order_item_id", "stg_order_items", "stg_orders", "stg_inventory", "stg_products", "stg_users")
def int_order_items_enriched(items: DataFrame, orders: DataFrame, units: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """One row per order item, with its order, unit, product and user; order_date is the order's."""
    rows = (
        items.withColumnsRenamed({"status": "order_item_status", "created_at": "order_item_created_at"})
        .join(orders.select("order_id", F.col("status").alias("order_status"), F.col("created_at").alias("order_created_at")), "order_id", "left")
        .join(units.select("inventory_item_id", F.col("cost").alias("product_cost"), "distribution_center_id"), "inventory_item_id", "left")
        .join(products.select("product_id", F.col("category").alias("product_category"), F.col("department").alias("product_department"), F.col("brand").alias("product_brand")), "product_id", "left")
        .join(users.select("user_id", F.col("traffic_source").alias("user_traffic_source")), "user_id", "left")
    )
    return rows.select(
        "order_item_id", "order_id", "user_id", "product_id", "inventory_item_id", "distribution_center_id", "order_item_status", "order_status", "sale_price", "product_cost",
        minus("sale_price", "product_cost").alias("gross_margin"), (F.col("order_item_status") == "Returned").alias("is_returned"), "order_item_created_at", "order_created_at",
        F.to_date("order_created_at").alias("order_date"), "shipped_at", "delivered_at", "returned_at", "product_category", "product_department", "product_brand", "user_traffic_source",
    )


def _costed(items: DataFrame, units: DataFrame) -> DataFrame:
    """Items with their unit's cost and no more: what rollups add up, without the joins of the enriched items."""
    cost = units.select("inventory_item_id", F.col("cost").alias("product_cost"))
    rows = items.select("order_id", "product_id", "inventory_item_id", "sale_price", (F.col("status") == "Returned").alias("is_returned"), F.col("created_at").alias("order_item_created_at"))
    return rows.join(cost, "inventory_item_id", "left").withColumn("gross_margin", minus("sale_price", "product_cost"))


@model("intermediate", "order_id", "stg_orders", "stg_order_items", "stg_inventory")
def int_orders_item_rollup(orders: DataFrame, items: DataFrame, units: DataFrame) -> DataFrame:
    """One row per order, without items too; whether all were returned is null where there is nothing to compare."""
    totals = _costed(items, units).groupBy("order_id").agg(
        F.count("*").alias("n"), F.sum(_one_if("is_returned")).alias("back"), F.sum("sale_price").alias("revenue"), F.sum("product_cost").alias("cost"), F.sum("gross_margin").alias("margin")
    )
    rows = orders.select("order_id", "user_id", F.col("status").alias("order_status"), F.col("created_at").alias("order_created_at")).join(totals, "order_id", "left")
    return rows.select(
        "order_id", "user_id", "order_status", "order_created_at", F.to_date("order_created_at").alias("order_date"), _count("n").alias("item_count"), _count("back").alias("returned_item_count"),
        _amount("revenue").alias("gross_revenue"), _amount("cost").alias("total_cost"), _amount("margin").alias("gross_margin"),
        ((F.coalesce("n", F.lit(0)) > 0) & (F.col("back") == F.col("n"))).alias("is_fully_returned"),
    )


@model("intermediate", "order_date", "int_orders_item_rollup")
def int_orders_daily(orders: DataFrame) -> DataFrame:
    """One row per UTC date with an order; returns belong to the order's date."""
    sums = [F.sum(c).cast(MONEY).alias(c) for c in ("gross_revenue", "total_cost", "gross_margin")]
    return orders.groupBy("order_date").agg(
        F.count("*").cast(INT).alias("order_count"), F.sum("item_count").cast(INT).alias("order_item_count"), F.countDistinct("user_id").cast(INT).alias("customer_count"),
        *sums, F.sum("returned_item_count").cast(INT).alias("returned_item_count"),
    )


@model("intermediate", "user_id", "stg_users", "int_orders_item_rollup")
def int_users_lifetime_orders(users: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per user, without orders too."""
    totals = orders.groupBy("user_id").agg(
        F.min("order_created_at").alias("first_order_at"), F.max("order_created_at").alias("last_order_at"), F.count("*").alias("lifetime_orders"), F.sum("item_count").alias("lifetime_items"),
        F.sum("gross_revenue").alias("lifetime_gross_revenue"), F.sum("total_cost").alias("lifetime_total_cost"), F.sum("gross_margin").alias("lifetime_gross_margin"), F.sum("returned_item_count").alias("lifetime_returned_items"),
    )
    counts = [_count(c).alias(c) for c in ("lifetime_orders", "lifetime_items")]
    amounts = [_amount(c).alias(c) for c in ("lifetime_gross_revenue", "lifetime_total_cost", "lifetime_gross_margin")]
    return users.select("user_id").join(totals, "user_id", "left").select("user_id", "first_order_at", "last_order_at", *counts, *amounts, _count("lifetime_returned_items").alias("lifetime_returned_items"))


@model("intermediate", "user_id", "stg_users", "stg_orders")
def int_users_first_order_cohort(users: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per user; the cohort is the month of the first order."""
    first = orders.groupBy("user_id").agg(F.min("created_at").alias("first_order_at"))
    return users.select("user_id", F.col("created_at").alias("signup_at")).join(first, "user_id", "left").withColumn("cohort_month", month_start("first_order_at"))


@model("intermediate", "user_month_key", "int_orders_item_rollup", "int_users_first_order_cohort")
def int_cohorts_user_months(orders: DataFrame, cohorts: DataFrame) -> DataFrame:
    """One row per user and UTC month with an order."""
    months = orders.groupBy("user_id", month_start("order_created_at").alias("activity_month")).agg(F.count("*").cast(INT).alias("orders"), F.sum("item_count").cast(INT).alias("items"), F.sum("gross_revenue").cast(MONEY).alias("revenue"))
    key = surrogate_key("user_id", month_number("activity_month"))
    return months.join(cohorts.select("user_id", "cohort_month"), "user_id", "left").select(key.alias("user_month_key"), "user_id", "cohort_month", "activity_month", "orders", "items", "revenue")


def product_totals(products: DataFrame, items: DataFrame, units: DataFrame) -> DataFrame:
    """One row per product, unsold too, with its sales and its returns from one aggregate of the items; every item is a unit sold."""
    totals = _costed(items, units).groupBy("product_id").agg(
        F.count("*").alias("n"), F.sum(_one_if("is_returned")).alias("back"), F.countDistinct("order_id").alias("orders_with_product"), F.sum("sale_price").alias("gross_revenue"), F.sum("product_cost").alias("total_cost"),
        F.sum("gross_margin").alias("gross_margin"), F.min("order_item_created_at").alias("first_sold_at"), F.max("order_item_created_at").alias("last_sold_at"),
    )
    amounts = [_amount(c).alias(c) for c in ("gross_revenue", "total_cost", "gross_margin")]
    rows = products.select("product_id").join(totals, "product_id", "left")
    return rows.select("product_id", _count("n").alias("units_sold"), _count("orders_with_product").alias("orders_with_product"), *amounts, "first_sold_at", "last_sold_at", _count("back").alias("returned_units"), safe_divide("back", "n").alias("return_rate"))


@model("intermediate", "product_id", "stg_products", "stg_order_items", "stg_inventory")
def int_products_sales(products: DataFrame, items: DataFrame, units: DataFrame) -> DataFrame:
    """One row per product, unsold too; every item is a unit sold, whatever its status."""
    return product_totals(products, items, units).drop("returned_units", "return_rate")


@model("intermediate", "product_id", "stg_products", "stg_order_items", "stg_inventory")
def int_products_returns(products: DataFrame, items: DataFrame, units: DataFrame) -> DataFrame:
    """One row per product; the rate of an unsold one is null."""
    return product_totals(products, items, units).select("product_id", "units_sold", "returned_units", "return_rate")


@model("intermediate", "inventory_item_id", "stg_inventory")
def int_inventory_enriched(units: DataFrame) -> DataFrame:
    """One row per unit; days to sell are null while it is open."""
    return units.select(
        "inventory_item_id", "product_id", "distribution_center_id", "product_category", "product_department", "product_brand", "product_name", "product_sku", F.col("cost").alias("unit_cost"), "product_retail_price",
        "created_at", "sold_at", F.col("sold_at").isNotNull().alias("is_sold"), (seconds_between("created_at", "sold_at") / F.lit(86400.0)).alias("days_to_sell"),
    )


@model("intermediate", "product_center_key", "int_inventory_enriched")
def int_inventory_by_product_center(units: DataFrame) -> DataFrame:
    """One row per product and center that ever held a unit of it."""
    unless_sold = lambda c: F.sum(F.when(F.col("is_sold"), F.lit(0).cast(MONEY)).otherwise(F.col(c))).cast(MONEY)
    rows = units.groupBy("product_id", "distribution_center_id").agg(
        F.count("*").cast(INT).alias("inventory_units"), F.sum(_one_if(~F.col("is_sold"))).cast(INT).alias("open_units"), F.sum(_one_if("is_sold")).cast(INT).alias("sold_units"),
        unless_sold("unit_cost").alias("open_inventory_value"), unless_sold("product_retail_price").alias("open_retail_value"),
    )
    return rows.select(surrogate_key("product_id", "distribution_center_id").alias("product_center_key"), *rows.columns)


@model("intermediate", "session_id", "stg_events")
def int_events_sessions(events: DataFrame) -> DataFrame:
    """One row per session; source and browser are its first event's.

    The first event is the least (number, id, source, browser) of a session: one aggregate, where a
    window and a join back would sort all events.
    """
    first = F.min_by(F.struct("traffic_source", "browser"), F.struct(F.coalesce("sequence_number", F.lit(2**62)), "event_id"))
    rows = events.groupBy("session_id").agg(
        F.max("user_id").alias("user_id"), F.min("created_at").alias("first_event_at"), F.max("created_at").alias("last_event_at"), F.count("*").cast(INT).alias("event_count"),
        F.max("sequence_number").cast(INT).alias("max_sequence_number"), F.max(_one_if(F.col("event_type") == "purchase")).alias("bought"), first.alias("first"),
    )
    return rows.select(
        "session_id", "user_id", "first_event_at", "last_event_at", seconds_between("first_event_at", "last_event_at").alias("session_seconds"), "event_count", "max_sequence_number",
        F.col("first.traffic_source").alias("traffic_source"), F.col("first.browser").alias("browser"), (F.col("bought") == 1).alias("has_purchase"),
    )


def gap_sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """One row per user and run of events without a gap of more than `minutes`: a window per user, then a sum of run beginnings.

    Events without a user are left out: they are of no one user, and would be one partition of the window.
    """
    events = events.where("user_id is not null")
    order = Window.partitionBy("user_id").orderBy("created_at", "event_id")
    gap = seconds_between(F.lag("created_at").over(order), "created_at")
    begun = events.withColumn("new", F.when(gap.isNull() | (gap > minutes * 60), 1).otherwise(0))
    numbered = begun.withColumn("session_number", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(INT))
    return numbered.groupBy("user_id", "session_number").agg(
        F.min("created_at").alias("first_event_at"), F.max("created_at").alias("last_event_at"), F.count("*").cast(INT).alias("event_count"), F.bool_or(F.col("event_type") == "purchase").alias("has_purchase")
    )
