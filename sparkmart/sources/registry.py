"""The seven source tables of a shop, declared once. They are read only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Columns and types that staging binds to, in order.
SCHEMAS = {
    "distribution_centers": "id bigint, name string, latitude double, longitude double, distribution_center_geom string",
    "products": "id bigint, cost double, category string, name string, brand string, retail_price double, department string, sku string, distribution_center_id bigint",
    "users": "id bigint, first_name string, last_name string, email string, age bigint, gender string, state string, street_address string, postal_code string, city string, country string, latitude double, longitude double, traffic_source string, created_at timestamp, user_geom string",
    "orders": "order_id bigint, user_id bigint, status string, gender string, created_at timestamp, returned_at timestamp, shipped_at timestamp, delivered_at timestamp, num_of_item bigint",
    "order_items": "id bigint, order_id bigint, user_id bigint, product_id bigint, inventory_item_id bigint, status string, created_at timestamp, shipped_at timestamp, delivered_at timestamp, returned_at timestamp, sale_price double",
    "inventory_items": "id bigint, product_id bigint, created_at timestamp, sold_at timestamp, cost double, product_category string, product_name string, product_brand string, product_retail_price double, product_department string, product_sku string, product_distribution_center_id bigint",
    "events": "id bigint, user_id bigint, sequence_number bigint, session_id string, created_at timestamp, ip_address string, city string, state string, postal_code string, browser string, traffic_source string, uri string, event_type string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


@dataclass
class Source:
    """Source tables by name; each is made once."""

    make: dict[str, Callable[[], DataFrame]]

    def __post_init__(self):
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.make:
            raise KeyError(f"no such source table: {name}; there are {', '.join(self.make)}")
        if name not in self._made:
            self._made[name] = self.make[name]()
        return self._made[name]

    def write(self, *_, **__):
        raise PermissionError("source tables are read only")


def from_folder(spark: SparkSession, folder: str) -> Source:
    """Source tables in their own schema, one Parquet table each; nothing is inferred."""
    return Source({n: (lambda n=n: spark.read.schema(schema(n)).parquet(f"{folder}/{n}.parquet")) for n in SCHEMAS})


def contract(found: StructType, declared: StructType, bound: list[str] | None = None) -> list[str]:
    """What a real schema breaks of a declared one: columns that are missing or have another type; and columns that models bind to but aren't declared. Further columns are inert."""
    have = {f.name: f.dataType for f in found}
    want = {f.name: f.dataType for f in declared}
    out = [f"missing: {n}" for n in want if n not in have]
    out += [f"type: {n} is {have[n].simpleString()}, declared {t.simpleString()}" for n, t in want.items() if n in have and have[n] != t]
    return out + [f"undeclared: {n}" for n in bound or [] if n not in want]
