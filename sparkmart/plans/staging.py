"""Staging: rename and cast, nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import FLOAT, INT, STRING, money, to_utc
from .registry import model


def _ints(*names: str) -> list[Column]:
    return [F.col(n).cast(INT).alias(n) for n in names]


def _texts(*names: str) -> list[Column]:
    return [F.col(n).cast(STRING).alias(n) for n in names]


def _times(*names: str) -> list[Column]:
    return [to_utc(n).alias(n) for n in names]


@model("staging", "order_id", "source.orders")
def stg_orders(orders: DataFrame) -> DataFrame:
    """One row per order."""
    return orders.select(*_ints("order_id", "user_id"), *_texts("status", "gender"), *_times("created_at", "returned_at", "shipped_at", "delivered_at"), *_ints("num_of_item"))


@model("staging", "order_item_id", "source.order_items")
def stg_order_items(items: DataFrame) -> DataFrame:
    """One row per order item."""
    return items.select(
        F.col("id").cast(INT).alias("order_item_id"), *_ints("order_id", "user_id", "product_id", "inventory_item_id"), *_texts("status"),
        *_times("created_at", "shipped_at", "delivered_at", "returned_at"), money("sale_price").alias("sale_price"),
    )


@model("staging", "user_id", "source.users")
def stg_users(users: DataFrame) -> DataFrame:
    """One row per user; the geometry is left out."""
    return users.select(
        F.col("id").cast(INT).alias("user_id"), *_texts("first_name", "last_name", "email"), *_ints("age"), *_texts("gender", "state", "street_address", "postal_code", "city", "country"),
        F.col("latitude").cast(FLOAT).alias("latitude"), F.col("longitude").cast(FLOAT).alias("longitude"), *_texts("traffic_source"), *_times("created_at"),
    )


@model("staging", "product_id", "source.products")
def stg_products(products: DataFrame) -> DataFrame:
    """One row per product."""
    return products.select(F.col("id").cast(INT).alias("product_id"), money("cost").alias("cost"), *_texts("category", "name", "brand"), money("retail_price").alias("retail_price"), *_texts("department", "sku"), *_ints("distribution_center_id"))


@model("staging", "inventory_item_id", "source.inventory_items")
def stg_inventory(units: DataFrame) -> DataFrame:
    """One row per unit, with the source's own copies of product columns."""
    return units.select(
        F.col("id").cast(INT).alias("inventory_item_id"), *_ints("product_id"), *_times("created_at", "sold_at"), money("cost").alias("cost"), *_texts("product_category", "product_name", "product_brand"),
        money("product_retail_price").alias("product_retail_price"), *_texts("product_department", "product_sku"), F.col("product_distribution_center_id").cast(INT).alias("distribution_center_id"),
    )


@model("staging", "distribution_center_id", "source.distribution_centers")
def stg_centers(centers: DataFrame) -> DataFrame:
    """One row per distribution center."""
    return centers.select(F.col("id").cast(INT).alias("distribution_center_id"), *_texts("name"), F.col("latitude").cast(FLOAT).alias("latitude"), F.col("longitude").cast(FLOAT).alias("longitude"))


@model("staging", "event_id", "source.events")
def stg_events(events: DataFrame) -> DataFrame:
    """One row per event; the user may be null."""
    return events.select(F.col("id").cast(INT).alias("event_id"), *_ints("user_id", "sequence_number"), *_texts("session_id"), *_times("created_at"), *_texts("ip_address", "city", "state", "postal_code", "browser", "traffic_source", "uri", "event_type"))
