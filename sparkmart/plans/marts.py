"""Marts: dimensions, facts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import INT, STRING, date_series, day_of_week_iso, days_between, format_month, int_series, json_value, month_number, month_start, quotient, round_money, safe_divide, struct_of, surrogate_key, unnest
from ..functions.types import MONEY
from .intermediate import _amount, _count, product_totals
from .registry import model


@model("mart", "user_id", "stg_users", "int_users_first_order_cohort", "int_users_lifetime_orders")
def dim_users(users: DataFrame, cohorts: DataFrame, lifetime: DataFrame) -> DataFrame:
    """One row per user."""
    who = users.select("user_id", "first_name", "last_name", "email", "age", "gender", "city", "state", "country", "postal_code", "traffic_source", F.col("created_at").alias("signup_at"))
    life = lifetime.select("user_id", "first_order_at", "last_order_at", "lifetime_orders", "lifetime_items", "lifetime_gross_revenue", "lifetime_gross_margin", "lifetime_returned_items")
    return who.join(cohorts.select("user_id", "cohort_month"), "user_id", "left").join(life, "user_id", "left")


@model("mart", "product_id", "stg_products", "stg_centers", "stg_order_items", "stg_inventory")
def dim_products(products: DataFrame, centers: DataFrame, items: DataFrame, units: DataFrame) -> DataFrame:
    """One row per product; sales and returns come from one aggregate."""
    totals = product_totals(products, items, units).select("product_id", "units_sold", "gross_revenue", "gross_margin", "returned_units", "return_rate")
    rows = products.join(centers.select("distribution_center_id", F.col("name").alias("distribution_center_name")), "distribution_center_id", "left").join(totals, "product_id", "left")
    return rows.select(
        "product_id", F.col("name").alias("product_name"), "sku", "category", "department", "brand", "distribution_center_id", "distribution_center_name", F.col("cost").alias("unit_cost"), "retail_price",
        "units_sold", "gross_revenue", "gross_margin", "returned_units", "return_rate",
    )


@model("mart", "distribution_center_id", "stg_centers", "int_inventory_by_product_center")
def dim_centers(centers: DataFrame, stock: DataFrame) -> DataFrame:
    """One row per center, empty ones too."""
    totals = stock.groupBy("distribution_center_id").agg(*(F.sum(c).alias(c) for c in ("inventory_units", "open_units", "sold_units", "open_inventory_value")))
    counts = [_count(c).alias(c) for c in ("inventory_units", "open_units", "sold_units")]
    return centers.join(totals, "distribution_center_id", "left").select("distribution_center_id", "name", "latitude", "longitude", *counts, _amount("open_inventory_value").alias("open_inventory_value"))


@model("mart", "date_day", "int_orders_daily")
def dim_date(days: DataFrame) -> DataFrame:
    """One row per UTC date from the first order to the last."""
    spine = days.agg(F.min("order_date").alias("first"), F.max("order_date").alias("last")).select("first", unnest(date_series("first", "last"), "date_day"))
    return spine.select(
        "date_day", format_month("date_day").cast(STRING).alias("date_month"), month_start(F.col("date_day").cast("timestamp_ntz")).alias("month_start_at"), F.year("date_day").cast(INT).alias("year_number"),
        F.month("date_day").cast(INT).alias("month_of_year"), F.day("date_day").cast(INT).alias("day_of_month"), day_of_week_iso("date_day").alias("day_of_week_iso"),
        (day_of_week_iso("date_day") >= 6).alias("is_weekend"), days_between("date_day", "first").alias("days_since_first_order"),
    ).orderBy("date_day")


@model("mart", "order_id", "int_orders_item_rollup", "stg_users")
def fct_orders(orders: DataFrame, users: DataFrame) -> DataFrame:
    """One row per order. The user's columns are taken from staging, of which the dimension has them unchanged."""
    who = users.select("user_id", F.col("country").alias("user_country"), F.col("state").alias("user_state"), F.col("traffic_source").alias("user_traffic_source"))
    return orders.join(who, "user_id", "left").select(
        "order_id", "user_id", "order_status", "order_created_at", "order_date", month_start("order_created_at").alias("order_month"), "item_count", "returned_item_count", "gross_revenue", "total_cost",
        "gross_margin", "is_fully_returned", "user_country", "user_state", "user_traffic_source",
    )


@model("mart", "order_item_id", "int_order_items_enriched", "stg_products", "stg_users")
def fct_order_items(items: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """One row per order item. Names, prices and places are staging's, of which the dimensions have them unchanged."""
    goods = products.select("product_id", F.col("name").alias("product_name"), F.col("retail_price").alias("product_retail_price"))
    who = users.select("user_id", F.col("country").alias("user_country"), F.col("state").alias("user_state"))
    return items.join(goods, "product_id", "left").join(who, "user_id", "left").select(
        "order_item_id", "order_id", "user_id", "product_id", "inventory_item_id", "distribution_center_id", "order_item_status", "order_status", "sale_price", "product_cost", "gross_margin", "is_returned",
        "order_item_created_at", "order_date", "product_name", "product_category", "product_department", "product_brand", "product_retail_price", "user_country", "user_state",
    )


@model("mart", "inventory_item_id", "int_inventory_enriched")
def fct_inventory_items(units: DataFrame) -> DataFrame:
    """One row per unit; stored by month of creation, sorted by product (see functions.layout)."""
    return units.select("inventory_item_id", "product_id", "distribution_center_id", "unit_cost", "product_retail_price", "created_at", "sold_at", "is_sold", "days_to_sell", "product_category", "product_department", "product_brand")


@model("mart", "revenue_date", "int_orders_daily")
def mart_daily_revenue(days: DataFrame) -> DataFrame:
    """One row per UTC date with an order, in order."""
    value = round_money(quotient("gross_revenue", "order_count")).alias("average_order_value")
    return days.select(F.col("order_date").alias("revenue_date"), "order_count", "order_item_count", "customer_count", "gross_revenue", "total_cost", "gross_margin", value, "returned_item_count").orderBy("revenue_date")


@model("mart", "product_id", "stg_products", "stg_order_items", "stg_inventory")
def mart_product_performance(products: DataFrame, items: DataFrame, units: DataFrame) -> DataFrame:
    """One row per product, best revenue first; sales and returns come from one aggregate."""
    rows = products.join(product_totals(products, items, units), "product_id", "left")
    return rows.select(
        "product_id", F.col("name").alias("product_name"), "category", "department", "brand", F.col("cost").alias("unit_cost"), "retail_price", "units_sold", "gross_revenue", "total_cost", "gross_margin",
        safe_divide("gross_margin", "gross_revenue").alias("gross_margin_rate"), "returned_units", "return_rate", "first_sold_at", "last_sold_at",
    ).orderBy(F.desc("gross_revenue"), "product_id")


@model("mart", "user_id", "dim_users", "int_cohorts_user_months")
def mart_customer_summary(users: DataFrame, months: DataFrame) -> DataFrame:
    """One row per user."""
    active = months.groupBy("user_id").agg(F.count("*").alias("n"))
    value = round_money(quotient("lifetime_gross_revenue", "lifetime_orders")).alias("average_order_value")
    return users.join(active, "user_id", "left").select(
        "user_id", "cohort_month", "signup_at", "first_order_at", "last_order_at", _count("n").alias("months_active"), "lifetime_orders", "lifetime_items", "lifetime_gross_revenue", "lifetime_gross_margin", value,
        F.col("lifetime_returned_items").alias("returned_item_count"), (F.col("lifetime_orders") > 1).alias("is_repeat_customer"),
    )


@model("mart", "cohort_activity_key", "int_cohorts_user_months")
def mart_cohort_retention(months: DataFrame) -> DataFrame:
    """One row per cohort month and month with an order; retention is of the cohort's size in its first month.

    The size comes from a window over the few months of a cohort, which saves joining the aggregate to itself.
    """
    rows = months.where("cohort_month is not null").groupBy("cohort_month", "activity_month").agg(F.countDistinct("user_id").cast(INT).alias("customers"), F.sum("orders").cast(INT).alias("orders"), F.sum("revenue").cast(MONEY).alias("revenue"))
    size = F.max(F.when(F.col("activity_month") == F.col("cohort_month"), F.col("customers"))).over(Window.partitionBy("cohort_month"))
    since = (F.year("activity_month") - F.year("cohort_month")) * 12 + F.month("activity_month") - F.month("cohort_month")
    return rows.select(
        surrogate_key(month_number("cohort_month"), month_number("activity_month")).alias("cohort_activity_key"), "cohort_month", "activity_month", since.cast(INT).alias("months_since_cohort"),
        "customers", "orders", "revenue", safe_divide("customers", size).alias("retention_rate"),
    ).orderBy("cohort_month", "activity_month")


@model("mart", "id")
def mart_types(spark: SparkSession) -> DataFrame:
    """One constant row with a value of each nested type."""
    pair = struct_of(("id", 1, INT), ("channel", "web", STRING))
    days = date_series(F.lit("2024-03-01").cast("date"), F.lit("2024-03-03").cast("date"))
    return spark.range(1).select(F.lit(1).cast(INT).alias("id"), int_series(1, 3).alias("int_array"), days.alias("date_array"), pair.alias("pair_struct"), json_value(pair).alias("pair_json"))
