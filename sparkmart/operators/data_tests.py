"""Tests of relations: each is a DataFrame of violating rows, and passes if it has none (or only warns)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that stand in more than one row; nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Other values with their counts; null passes. Not for booleans, of which any value would be listed."""
    if not values:
        raise ValueError("no accepted values")
    if dict(df.dtypes)[column] == "boolean":
        raise ValueError(f"{column} is a boolean: test it with not_null")
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where(~F.col("value").isin(values))


def relationships(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose value no parent has; null passes."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")).distinct(), F.col(column) == F.col("__key"), "left_anti")


@dataclass(frozen=True)
class Test:
    name: str
    violations: Callable[[], DataFrame]
    severity: str = "error"

    def __post_init__(self):
        if self.severity not in ("warn", "error"):
            raise ValueError(f"no such severity: {self.severity!r}")

    def run(self) -> dict:
        n = self.violations().count()
        return {"test": self.name, "violations": n, "passed": n == 0 or self.severity == "warn", "warned": n > 0 and self.severity == "warn"}


def counted(*named: tuple[str, DataFrame]) -> DataFrame:
    """(check_name, violations): the number of rows of each, in one union."""
    out = None
    for name, df in named:
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no checks")
    return out


def orphan_items(items: DataFrame, orders: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """Items without an order, user or product, or of another user than their order."""
    rows = (
        items.select("order_item_id", "order_id", "user_id", "product_id")
        .join(orders.select("order_id", F.col("user_id").alias("order_user_id"), F.lit(True).alias("o")), "order_id", "left")
        .join(users.select("user_id", F.lit(True).alias("u")), "user_id", "left")
        .join(products.select("product_id", F.lit(True).alias("p")), "product_id", "left")
    )
    missing = [F.col(c).isNull().alias(n) for c, n in (("o", "missing_order"), ("u", "missing_user"), ("p", "missing_product"))]
    return rows.where("o is null or u is null or p is null or order_user_id <> user_id").select("order_item_id", "order_id", "user_id", "product_id", *missing, "order_user_id")


def item_counts(orders: DataFrame, items: DataFrame, facts: DataFrame) -> DataFrame:
    """Orders whose declared number of items isn't the number counted, or that of the order fact."""
    n = items.groupBy("order_id").agg(F.count("*").alias("n"))
    rows = orders.select("order_id", "num_of_item").join(n, "order_id", "left").join(facts.select("order_id", F.col("item_count").alias("fct_item_count")), "order_id", "left")
    rows = rows.withColumn("order_item_count", F.coalesce("n", F.lit(0).cast("long")))
    wrong = "num_of_item is null or num_of_item <> order_item_count or fct_item_count is null or fct_item_count <> order_item_count"
    return rows.where(wrong).select("order_id", "num_of_item", "order_item_count", "fct_item_count")


def lifecycle(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Records whose times are out of order; a time that isn't there breaks nothing."""
    late = "shipped_at > delivered_at or shipped_at > returned_at or delivered_at > returned_at"
    early = " or ".join(f"created_at > {c}" for c in ("shipped_at", "delivered_at", "returned_at"))
    a = orders.where(f"{late} or {early}").select(F.lit("orders").alias("record_type"), F.col("order_id").alias("record_id"))
    return a.unionByName(items.where(late).select(F.lit("order_items").alias("record_type"), F.col("order_item_id").alias("record_id")))


def plausible(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Items created after their own milestones, or before their order: to be warned of."""
    late = items.where("created_at > shipped_at or created_at > delivered_at or created_at > returned_at").select(F.lit("order_item_created_after_lifecycle").alias("record_type"), F.col("order_item_id").alias("record_id"))
    both = items.select("order_item_id", "order_id", "created_at").join(orders.select("order_id", F.col("created_at").alias("ordered_at")), "order_id").where("created_at < ordered_at")
    return late.unionByName(both.select(F.lit("order_item_created_before_order").alias("record_type"), F.col("order_item_id").alias("record_id")))


def source_checks(t: Callable[[str], DataFrame]) -> list[tuple[str, DataFrame]]:
    """Rules that source tables keep: no orphans, agreement, order in time, vocabulary and sign."""
    items, orders, users, products, units, centers, events = (t(n) for n in ("order_items", "orders", "users", "products", "inventory_items", "distribution_centers", "events"))

    def orphans(df: DataFrame, c: str, parent: DataFrame, key: str) -> DataFrame:
        return df.select(c).join(parent.select(F.col(key).alias("__key")), F.col(c) == F.col("__key"), "left_anti")

    both = items.withColumnsRenamed({"user_id": "item_user", "created_at": "item_created"}).join(orders.select("order_id", "user_id", F.col("created_at").alias("ordered")), "order_id")
    n = items.groupBy("order_id").agg(F.count("*").alias("n"))
    used = items.select(F.col("inventory_item_id").alias("__unit")).where("__unit is not null").distinct().withColumn("__used", F.lit(True))
    sold = units.join(used, F.col("id") == F.col("__unit"), "left").where(F.col("sold_at").isNotNull() != F.col("__used").isNotNull())
    sent = "created_at > shipped_at or shipped_at > delivered_at or delivered_at > returned_at"
    first = orders.groupBy(F.col("user_id").alias("id")).agg(F.min("created_at").alias("first"))
    status = orders.select("status", "returned_at").unionByName(items.select("status", "returned_at"))
    signed = users.select(F.col("id").alias("user_id"), F.col("created_at").alias("signed"))
    return [
        ("order_items without order", orphans(items, "order_id", orders, "order_id")),
        ("order_items without user", orphans(items, "user_id", users, "id")),
        ("order_items without product", orphans(items, "product_id", products, "id")),
        ("order_items without unit", orphans(items, "inventory_item_id", units, "id")),
        ("orders without user", orphans(orders, "user_id", users, "id")),
        ("units without product", orphans(units, "product_id", products, "id")),
        ("products without center", orphans(products, "distribution_center_id", centers, "id")),
        ("events without user", orphans(events, "user_id", users, "id")),
        ("item of another user than its order", both.where("item_user <> user_id")),
        ("declared items are not those counted", orders.join(n, "order_id", "left").where("num_of_item <> coalesce(n, 0)")),
        ("item of another product than its unit", items.select("inventory_item_id", F.col("product_id").alias("item_product")).join(units, F.col("inventory_item_id") == F.col("id")).where("item_product <> product_id")),
        ("item before its order", both.where("ordered > item_created")),
        ("orders out of time order", orders.where(sent)),
        ("order_items out of time order", items.where(sent)),
        ("returned without a time, or the reverse", status.where((F.col("status") == "Returned") != F.col("returned_at").isNotNull())),
        ("sold unit without item, or the reverse", sold),
        ("unit in several items", items.groupBy("inventory_item_id").count().where("count > 1")),
        ("item without a unit's id", items.where("inventory_item_id is null")),
        ("unit sold before it was there", units.where("created_at > sold_at")),
        ("order not after sign-up", users.join(first, "id").where("created_at >= first")),
        ("price not above zero", items.where("sale_price <= 0")),
        ("product below cost", products.where("retail_price < cost")),
        ("session that doesn't begin at 1", events.groupBy("session_id").agg(F.min("sequence_number").alias("m")).where("m <> 1")),
        ("event before sign-up", events.join(signed, "user_id").where("created_at < signed")),
    ]


def staging_checks(g) -> list[tuple[str, DataFrame]]:
    """Rules that staging keeps; g gives a model by name."""
    items, orders, users, products, units, centers, events = (g[f"stg_{n}"] for n in ("order_items", "orders", "users", "products", "inventory", "centers", "events"))
    anti = lambda a, b, k: a.join(b.select(k), k, "left_anti")

    def missing(a: DataFrame, *parents: tuple[DataFrame, str]) -> DataFrame:
        for k, (b, key) in enumerate(parents):
            a = a.join(b.select(key, F.lit(True).alias(f"__has{k}")), key, "left")
        return a.where(" or ".join(f"__has{k} is null" for k in range(len(parents))))

    n = items.groupBy("order_id").agg(F.count("*").alias("n"))
    both = items.select("order_id", "created_at").join(orders.select("order_id", F.col("created_at").alias("ordered")), "order_id")
    centered = units.select("product_id", "distribution_center_id").join(products.select("product_id", F.col("distribution_center_id").alias("own")), "product_id")
    return [
        ("items without parents", missing(items, (orders, "order_id"), (users, "user_id"), (products, "product_id"), (units, "inventory_item_id"))),
        ("orders without user", anti(orders, users, "user_id")),
        ("events without user", anti(events, users, "user_id")),
        ("units without product or center", missing(units, (products, "product_id"), (centers, "distribution_center_id"))),
        ("declared items are not those counted", orders.join(n, "order_id", "left").where("num_of_item <> coalesce(n, 0)")),
        ("item before its order", both.where("created_at < ordered")),
        ("items out of time order", items.where("shipped_at < created_at or delivered_at < shipped_at or returned_at < delivered_at")),
        ("unit sold before it was there", units.where("sold_at < created_at")),
        ("unit in another center than its product", centered.where("distribution_center_id <> own")),
        ("declared items of all orders are not all items", orders.agg(F.sum("num_of_item").alias("s")).crossJoin(items.agg(F.count("*").alias("n"))).where("s <> n")),
    ]


def grain(name: str, df: DataFrame, *key: str) -> DataFrame:
    """(relation, key, n_rows, n_keys, null_keys, grain_ok); keys of several columns count tuples that hold nulls too."""
    one = F.struct(*key) if len(key) > 1 else F.col(key[0])
    null = F.count_if(F.greatest(*(F.col(k).isNull().cast("int") for k in key), F.lit(0)) > 0)
    rows = df.agg(F.count("*").alias("n_rows"), F.countDistinct(one).alias("n_keys"), null.alias("null_keys"))
    return rows.select(F.lit(name).alias("relation"), F.lit(", ".join(key)).alias("key"), "n_rows", "n_keys", "null_keys", ((F.col("n_rows") == F.col("n_keys")) & (F.col("null_keys") == 0)).alias("grain_ok"))


def reconciled(g) -> DataFrame:
    """(check_name, ok): figures that must agree across models."""

    def total(model: str, c: str, name: str) -> DataFrame:
        return g[model].agg(F.sum(c).alias(name))

    def agree(name: str, first: DataFrame, *others: DataFrame) -> DataFrame:
        rows = first
        for o in others:  # relations of one row each
            rows = rows.crossJoin(o)
        a, *rest = rows.columns
        ok = F.lit(True)
        for c in rest:
            ok = ok & F.col(a).eqNullSafe(F.col(c))
        return rows.select(F.lit(name).alias("check_name"), ok.alias("ok"))

    def every(name: str, model: str, rule: str) -> DataFrame:
        return g[model].agg(F.coalesce(F.bool_and(F.expr(rule)), F.lit(True)).alias("ok")).select(F.lit(name).alias("check_name"), "ok")

    items = g["stg_order_items"].agg(F.count("*").alias("n"))
    checks = [
        agree("items of orders are all items", total("int_orders_item_rollup", "item_count", "a"), items),
        agree("a unit is in one item", g["int_order_items_enriched"].agg(F.countDistinct("inventory_item_id").alias("a")), items),
        agree("revenue is the same everywhere", total("stg_order_items", "sale_price", "a"), total("int_orders_daily", "gross_revenue", "b"), total("int_users_lifetime_orders", "lifetime_gross_revenue", "c"), total("int_products_sales", "gross_revenue", "d"), total("int_cohorts_user_months", "revenue", "e")),
        agree("units are sold or open", total("int_inventory_by_product_center", "inventory_units", "a"), g["int_inventory_by_product_center"].agg((F.sum("sold_units") + F.sum("open_units")).alias("b")), g["stg_inventory"].agg(F.count("*").alias("c"))),
        agree("sessions hold all events", total("int_events_sessions", "event_count", "a"), g["stg_events"].agg(F.count("*").alias("b"))),
        every("return rates are shares", "int_products_returns", "return_rate between 0 and 1"),
        every("days to sell", "int_inventory_enriched", "(days_to_sell is null) = (not is_sold) and coalesce(days_to_sell, 0) >= 0"),
        every("cohorts begin months", "int_cohorts_user_months", "cohort_month <= activity_month and day(activity_month) = 1 and day(cohort_month) = 1"),
        every("keys of user months", "int_cohorts_user_months", "user_month_key = md5(concat(user_id, '||', date_format(activity_month, 'yyyyMM')))"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
