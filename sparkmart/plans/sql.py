"""The models in DuckDB's SQL over the driver's tables, to compare results with."""

from __future__ import annotations

import re

from ..sources.warehouse import SQL as SOURCES

D = "DECIMAL(38,9)"


def quotient(n: str, d: str) -> str:
    """Money over a whole number to nine decimals, half away from zero, in whole nanos."""
    nanos = f"(({n}) * 1000000000)::HUGEINT"
    half = f"(2 * abs({nanos}) + abs({d})) // (2 * abs({d}))"
    return f"(CASE WHEN {d} <> 0 THEN ((sign({n}) * sign({d}))::HUGEINT * ({half}))::DECIMAL(38,0) * 0.000000001::DECIMAL(10,9) END)::{D}"


MONTH = "date_trunc('month', {0})::TIMESTAMP".format
YM = "(year({0}) * 100 + month({0}))".format
SECONDS = "date_diff('microsecond', {0}, {1}) / 1000000.0::DOUBLE".format

MODELS = {
    "stg_orders": "SELECT order_id, user_id, status, gender, created_at, returned_at, shipped_at, delivered_at, num_of_item::BIGINT AS num_of_item FROM src_orders",
    "stg_order_items": f"SELECT id AS order_item_id, order_id, user_id, product_id, inventory_item_id, status, created_at, shipped_at, delivered_at, returned_at, sale_price::{D} AS sale_price FROM src_order_items",
    "stg_users": "SELECT id AS user_id, first_name, last_name, email, age, gender, state, street_address, postal_code, city, country, latitude, longitude, traffic_source, created_at FROM src_users",
    "stg_products": f"SELECT id AS product_id, cost::{D} AS cost, category, name, brand, retail_price::{D} AS retail_price, department, sku, distribution_center_id FROM src_products",
    "stg_inventory": f"SELECT id AS inventory_item_id, product_id, created_at, sold_at, cost::{D} AS cost, product_category, product_name, product_brand, product_retail_price::{D} AS product_retail_price, product_department, product_sku, product_distribution_center_id AS distribution_center_id FROM src_inventory_items",
    "stg_centers": "SELECT id AS distribution_center_id, name, latitude, longitude FROM src_distribution_centers",
    "stg_events": "SELECT id AS event_id, user_id, sequence_number, session_id, created_at, ip_address, NULL::VARCHAR AS city, NULL::VARCHAR AS state, NULL::VARCHAR AS postal_code, browser, traffic_source, uri, event_type FROM src_events",
    "int_order_items_enriched": f"""
        SELECT i.order_item_id, i.order_id, i.user_id, i.product_id, i.inventory_item_id, u.distribution_center_id, i.status AS order_item_status, o.status AS order_status, i.sale_price,
          u.cost AS product_cost, (i.sale_price - u.cost)::{D} AS gross_margin, i.status = 'Returned' AS is_returned, i.created_at AS order_item_created_at, o.created_at AS order_created_at,
          o.created_at::DATE AS order_date, i.shipped_at, i.delivered_at, i.returned_at, p.category AS product_category, p.department AS product_department, p.brand AS product_brand,
          c.traffic_source AS user_traffic_source
        FROM stg_order_items i LEFT JOIN stg_orders o USING (order_id) LEFT JOIN stg_inventory u ON u.inventory_item_id = i.inventory_item_id
          LEFT JOIN stg_products p ON p.product_id = i.product_id LEFT JOIN stg_users c ON c.user_id = i.user_id""",
    "int_orders_item_rollup": f"""
        SELECT o.order_id, o.user_id, o.status AS order_status, o.created_at AS order_created_at, o.created_at::DATE AS order_date, coalesce(n, 0)::BIGINT AS item_count,
          coalesce(back, 0)::BIGINT AS returned_item_count, coalesce(revenue, 0)::{D} AS gross_revenue, coalesce(cost, 0)::{D} AS total_cost, coalesce(margin, 0)::{D} AS gross_margin,
          coalesce(n, 0) > 0 AND back = n AS is_fully_returned
        FROM stg_orders o LEFT JOIN (
          SELECT order_id, count(*) AS n, count(*) FILTER (is_returned) AS back, sum(sale_price) AS revenue, sum(product_cost) AS cost, sum(gross_margin) AS margin
          FROM int_order_items_enriched GROUP BY order_id) USING (order_id)""",
    "int_orders_daily": f"""
        SELECT order_date, count(*)::BIGINT AS order_count, sum(item_count)::BIGINT AS order_item_count, count(DISTINCT user_id)::BIGINT AS customer_count, sum(gross_revenue)::{D} AS gross_revenue,
          sum(total_cost)::{D} AS total_cost, sum(gross_margin)::{D} AS gross_margin, sum(returned_item_count)::BIGINT AS returned_item_count FROM int_orders_item_rollup GROUP BY order_date""",
    "int_users_lifetime_orders": f"""
        SELECT user_id, first_order_at, last_order_at, coalesce(n, 0)::BIGINT AS lifetime_orders, coalesce(items, 0)::BIGINT AS lifetime_items, coalesce(r, 0)::{D} AS lifetime_gross_revenue,
          coalesce(c, 0)::{D} AS lifetime_total_cost, coalesce(m, 0)::{D} AS lifetime_gross_margin, coalesce(b, 0)::BIGINT AS lifetime_returned_items
        FROM stg_users LEFT JOIN (
          SELECT user_id, min(order_created_at) AS first_order_at, max(order_created_at) AS last_order_at, count(*) AS n, sum(item_count) AS items, sum(gross_revenue) AS r, sum(total_cost) AS c,
            sum(gross_margin) AS m, sum(returned_item_count) AS b FROM int_orders_item_rollup GROUP BY user_id) USING (user_id)""",
    "int_users_first_order_cohort": f"""
        SELECT user_id, u.created_at AS signup_at, first_order_at, {MONTH("first_order_at")} AS cohort_month
        FROM stg_users u LEFT JOIN (SELECT user_id, min(created_at) AS first_order_at FROM stg_orders GROUP BY user_id) USING (user_id)""",
    "int_cohorts_user_months": f"""
        SELECT md5(user_id || '||' || {YM("activity_month")}) AS user_month_key, user_id, cohort_month, activity_month, orders, items, revenue
        FROM (SELECT user_id, {MONTH("order_created_at")} AS activity_month, count(*)::BIGINT AS orders, sum(item_count)::BIGINT AS items, sum(gross_revenue)::{D} AS revenue
          FROM int_orders_item_rollup GROUP BY ALL) LEFT JOIN int_users_first_order_cohort USING (user_id)""",
    "int_products_sales": f"""
        SELECT product_id, coalesce(n, 0)::BIGINT AS units_sold, coalesce(o, 0)::BIGINT AS orders_with_product, coalesce(r, 0)::{D} AS gross_revenue, coalesce(c, 0)::{D} AS total_cost,
          coalesce(m, 0)::{D} AS gross_margin, first_sold_at, last_sold_at
        FROM stg_products LEFT JOIN (
          SELECT product_id, count(*) AS n, count(DISTINCT order_id) AS o, sum(sale_price) AS r, sum(product_cost) AS c, sum(gross_margin) AS m, min(order_item_created_at) AS first_sold_at,
            max(order_item_created_at) AS last_sold_at FROM int_order_items_enriched GROUP BY product_id) USING (product_id)""",
    "int_products_returns": """
        SELECT product_id, coalesce(n, 0)::BIGINT AS units_sold, coalesce(b, 0)::BIGINT AS returned_units, b::DOUBLE / nullif(n::DOUBLE, 0) AS return_rate
        FROM stg_products LEFT JOIN (SELECT product_id, count(*) AS n, count(*) FILTER (is_returned) AS b FROM int_order_items_enriched GROUP BY product_id) USING (product_id)""",
    "int_inventory_enriched": f"""
        SELECT inventory_item_id, product_id, distribution_center_id, product_category, product_department, product_brand, product_name, product_sku, cost AS unit_cost, product_retail_price,
          created_at, sold_at, sold_at IS NOT NULL AS is_sold, {SECONDS("created_at", "sold_at")} / 86400.0::DOUBLE AS days_to_sell FROM stg_inventory""",
    "int_inventory_by_product_center": f"""
        SELECT md5(product_id || '||' || distribution_center_id) AS product_center_key, product_id, distribution_center_id, count(*)::BIGINT AS inventory_units,
          count(*) FILTER (NOT is_sold)::BIGINT AS open_units, count(*) FILTER (is_sold)::BIGINT AS sold_units, sum(CASE WHEN is_sold THEN 0 ELSE unit_cost END)::{D} AS open_inventory_value,
          sum(CASE WHEN is_sold THEN 0 ELSE product_retail_price END)::{D} AS open_retail_value FROM int_inventory_enriched GROUP BY product_id, distribution_center_id""",
    "int_events_sessions": f"""
        SELECT session_id, user_id, a AS first_event_at, b AS last_event_at, {SECONDS("a", "b")} AS session_seconds, n AS event_count, m AS max_sequence_number, f.traffic_source, f.browser, has_purchase
        FROM (SELECT session_id, max(user_id) AS user_id, min(created_at) AS a, max(created_at) AS b, count(*)::BIGINT AS n, max(sequence_number)::BIGINT AS m, bool_or(event_type = 'purchase') AS has_purchase
          FROM stg_events GROUP BY session_id)
        LEFT JOIN (SELECT session_id, traffic_source, browser FROM stg_events QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sequence_number, event_id) = 1) f USING (session_id)""",
    "dim_users": """
        SELECT user_id, first_name, last_name, email, age, gender, city, state, country, postal_code, traffic_source, u.created_at AS signup_at, cohort_month, l.first_order_at, last_order_at,
          lifetime_orders, lifetime_items, lifetime_gross_revenue, lifetime_gross_margin, lifetime_returned_items
        FROM stg_users u LEFT JOIN int_users_first_order_cohort USING (user_id) LEFT JOIN int_users_lifetime_orders l USING (user_id)""",
    "dim_products": """
        SELECT product_id, p.name AS product_name, sku, category, department, brand, distribution_center_id, c.name AS distribution_center_name, cost AS unit_cost, retail_price, s.units_sold,
          s.gross_revenue, s.gross_margin, r.returned_units, r.return_rate
        FROM stg_products p LEFT JOIN stg_centers c USING (distribution_center_id) LEFT JOIN int_products_sales s USING (product_id) LEFT JOIN int_products_returns r USING (product_id)""",
    "dim_centers": f"""
        SELECT distribution_center_id, name, latitude, longitude, coalesce(a, 0)::BIGINT AS inventory_units, coalesce(b, 0)::BIGINT AS open_units, coalesce(c, 0)::BIGINT AS sold_units,
          coalesce(d, 0)::{D} AS open_inventory_value
        FROM stg_centers LEFT JOIN (SELECT distribution_center_id, sum(inventory_units) AS a, sum(open_units) AS b, sum(sold_units) AS c, sum(open_inventory_value) AS d
          FROM int_inventory_by_product_center GROUP BY distribution_center_id) USING (distribution_center_id)""",
    "dim_date": f"""
        SELECT d AS date_day, strftime(d, '%Y-%m') AS date_month, {MONTH("d")} AS month_start_at, year(d)::BIGINT AS year_number, month(d)::BIGINT AS month_of_year, day(d)::BIGINT AS day_of_month,
          isodow(d)::BIGINT AS day_of_week_iso, isodow(d) >= 6 AS is_weekend, date_diff('day', a, d)::BIGINT AS days_since_first_order
        FROM (SELECT a, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM (SELECT min(order_date) AS a, max(order_date) AS b FROM int_orders_daily))""",
    "fct_orders": f"""
        SELECT order_id, user_id, order_status, order_created_at, order_date, {MONTH("order_created_at")} AS order_month, item_count, returned_item_count, gross_revenue, total_cost, gross_margin,
          is_fully_returned, country AS user_country, state AS user_state, traffic_source AS user_traffic_source FROM int_orders_item_rollup LEFT JOIN dim_users USING (user_id)""",
    "fct_order_items": """
        SELECT order_item_id, order_id, user_id, product_id, inventory_item_id, i.distribution_center_id, order_item_status, order_status, sale_price, product_cost, i.gross_margin, is_returned,
          order_item_created_at, order_date, product_name, product_category, product_department, product_brand, retail_price AS product_retail_price, country AS user_country, state AS user_state
        FROM int_order_items_enriched i LEFT JOIN dim_products p USING (product_id) LEFT JOIN dim_users USING (user_id)""",
    "fct_inventory_items": "SELECT inventory_item_id, product_id, distribution_center_id, unit_cost, product_retail_price, created_at, sold_at, is_sold, days_to_sell, product_category, product_department, product_brand FROM int_inventory_enriched",
    "mart_daily_revenue": f"""
        SELECT order_date AS revenue_date, order_count, order_item_count, customer_count, gross_revenue, total_cost, gross_margin,
          round({quotient("gross_revenue", "order_count")}, 2)::{D} AS average_order_value, returned_item_count FROM int_orders_daily""",
    "mart_product_performance": """
        SELECT product_id, name AS product_name, category, department, brand, cost AS unit_cost, retail_price, s.units_sold, gross_revenue, total_cost, gross_margin,
          gross_margin::DOUBLE / nullif(gross_revenue::DOUBLE, 0) AS gross_margin_rate, returned_units, return_rate, first_sold_at, last_sold_at
        FROM stg_products LEFT JOIN int_products_sales s USING (product_id) LEFT JOIN int_products_returns USING (product_id)""",
    "mart_customer_summary": f"""
        SELECT user_id, cohort_month, signup_at, first_order_at, last_order_at, coalesce(n, 0)::BIGINT AS months_active, lifetime_orders, lifetime_items, lifetime_gross_revenue, lifetime_gross_margin,
          round({quotient("lifetime_gross_revenue", "lifetime_orders")}, 2)::{D} AS average_order_value, lifetime_returned_items AS returned_item_count, lifetime_orders > 1 AS is_repeat_customer
        FROM dim_users LEFT JOIN (SELECT user_id, count(*) AS n FROM int_cohorts_user_months GROUP BY user_id) USING (user_id)""",
    "mart_cohort_retention": f"""
        WITH m AS (SELECT cohort_month, activity_month, count(DISTINCT user_id)::BIGINT AS customers, sum(orders)::BIGINT AS orders, sum(revenue)::{D} AS revenue
          FROM int_cohorts_user_months WHERE cohort_month IS NOT NULL GROUP BY ALL)
        SELECT md5({YM("m.cohort_month")} || '||' || {YM("m.activity_month")}) AS cohort_activity_key, m.cohort_month, m.activity_month,
          date_diff('month', m.cohort_month, m.activity_month)::BIGINT AS months_since_cohort, m.customers, m.orders, m.revenue, m.customers::DOUBLE / nullif(s.customers::DOUBLE, 0) AS retention_rate
        FROM m LEFT JOIN m s ON s.cohort_month = m.cohort_month AND s.activity_month = s.cohort_month""",
}


def with_models(body: str) -> str:
    """A query over models and source tables, with those that it reads, directly or not, before it."""
    every = SOURCES | MODELS
    need: set[str] = set()

    def walk(text: str) -> None:
        for name in set(re.findall(r"\b(?:src|stg|int|dim|fct|mart)_\w+", text)):
            if name in every and name not in need:
                need.add(name)
                walk(every[name])

    walk(body)
    parts = [f"{n} AS ({every[n]})" for n in every if n in need]
    body = body.strip()
    rest = f", {body[5:]}" if body.upper().startswith("WITH ") else f" {body}"
    return f"WITH {', '.join(parts)}{rest}" if parts else body


def oracle(name: str) -> str:
    return with_models(f"SELECT * FROM {name}")
