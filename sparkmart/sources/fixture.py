"""A deterministic shop in the sources' own schema, for tests: draws are hashes of a key and a salt.

Volumes: 10 centers, 200 products, 400 users, 3,000 orders, 8,000 items, 10,000 units (2,000 open), 20,000 events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import SCHEMAS, Source, schema

#: Vocabularies of the sources.
STATUS = ["Complete", "Shipped", "Processing", "Returned", "Cancelled"]
CHANNELS = ["Search", "Organic", "Facebook", "Email", "Display"]
EVENT_CHANNELS = ["Email", "Adwords", "Facebook", "YouTube", "Organic"]
START, DAY = 1640995200, 86400  # 2022-01-01


def draw(key: Column | str, salt: int) -> Column:
    """A number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(salt)), F.lit(1_000_000)) / 1_000_000.0


def pick(values: list, key: Column | str, salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(key, salt) * len(values)).cast("int") + 1)


def at(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.cast("long"))


def shop(spark: SparkSession) -> Source:
    def shaped(df: DataFrame, name: str) -> DataFrame:
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(name)))

    def centers():
        return shaped(spark.range(1, 11).withColumns({"name": F.concat(F.lit("Center "), "id"), "latitude": draw("id", 1) * 20 + 25, "longitude": -70 - draw("id", 2) * 50}).withColumn("distribution_center_geom", F.concat(F.lit("POINT("), "longitude", F.lit(" "), "latitude", F.lit(")"))), "distribution_centers")

    def products():
        price = F.round(draw("id", 3) * 190 + 5, 2)
        rows = spark.range(1, 201).withColumns({"retail_price": price, "cost": F.round(price * (0.3 + draw("id", 4) * 0.3), 4), "category": pick(["Jeans", "Tops", "Shoes", "Socks"], "id", 5), "brand": pick(["Ada", "Bell", "Curie"], "id", 6), "department": pick(["Men", "Women"], "id", 7), "distribution_center_id": F.col("id") % 10 + 1})
        return shaped(rows.withColumns({"name": F.concat_ws(" ", "brand", "category", "id"), "sku": F.upper(F.md5(F.col("id").cast("string")))}), "products")

    def users():
        made = START + (draw("id", 8) * 1277 * DAY).cast("long")
        rows = spark.range(1, 401).withColumns({"first_name": pick(["Ana", "Bo", "Cy"], "id", 9), "last_name": pick(["Diaz", "Eng", "Fox"], "id", 10), "age": (draw("id", 11) * 60 + 12).cast("long"), "gender": pick(["M", "F"], "id", 12), "country": pick(["Brasil", "China", "France"], "id", 13), "state": pick(["A", "B"], "id", 14), "city": pick(["X", "Y"], "id", 15), "traffic_source": pick(CHANNELS, "id", 16), "created_at": at(made)})
        return shaped(rows.withColumn("email", F.concat(F.lower("first_name"), "id", F.lit("@example.com"))), "users")

    def counts() -> DataFrame:
        # 500 of one item, 800 of two, 900 of three, 800 of four: 8,000
        n = F.when(F.col("order_id") <= 500, 1).when(F.col("order_id") <= 1300, 2).when(F.col("order_id") <= 2200, 3).otherwise(4)
        return spark.range(1, 3001).select(F.col("id").alias("order_id"), n.cast("long").alias("num_of_item"), (draw("id", 17) * 400).cast("long").alias("u")).withColumn("user_id", F.col("u") + 1).drop("u")

    def orders():
        rows = counts().join(users().select(F.col("id").alias("user_id"), "gender", F.unix_seconds("created_at").alias("signed")), "user_id")
        rows = rows.withColumns({"status": pick(STATUS, "order_id", 18), "t": F.col("signed") + 3600 + (draw("order_id", 19) * (1767225600 - 20 * DAY - F.col("signed") - 3600)).cast("long")})
        sent = F.col("status").isin("Complete", "Shipped", "Returned")
        ship = F.col("t") + 3600 + (draw("order_id", 20) * 2 * DAY).cast("long")
        deliver, back = ship + 3600 + (draw("order_id", 21) * 4 * DAY).cast("long"), ship + 5 * DAY + 3600
        return shaped(rows.withColumns({"created_at": at(F.col("t")), "shipped_at": F.when(sent, at(ship)), "delivered_at": F.when(F.col("status").isin("Complete", "Returned"), at(deliver)), "returned_at": F.when(F.col("status") == "Returned", at(back))}), "orders")

    def numbered() -> DataFrame:
        lines = orders().select("order_id", "user_id", "status", "created_at", "shipped_at", "delivered_at", "returned_at", F.explode(F.sequence(F.lit(1), F.col("num_of_item"))).alias("line"))
        return lines.withColumn("id", F.row_number().over(Window.orderBy("order_id", "line")).cast("long"))

    def order_items():
        goods = products().select(F.col("id").alias("product_id"), "retail_price")
        rows = numbered().withColumns({"inventory_item_id": F.col("id"), "product_id": (draw("id", 22) * 200).cast("long") + 1, "created_at": F.col("created_at")})
        return shaped(rows.join(goods, "product_id").withColumn("sale_price", F.col("retail_price") * (1 - draw("id", 23) * 0.2)), "order_items")

    def inventory_items():
        sold = order_items().select("id", "product_id", F.col("created_at").alias("sold_at"), at(F.unix_seconds("created_at") - 3600 - (draw("id", 24) * 30 * DAY).cast("long")).alias("created_at"))
        left = spark.range(8001, 10001).select("id", ((draw("id", 22) * 200).cast("long") + 1).alias("product_id"), F.lit(None).cast("timestamp").alias("sold_at"), at(START + (draw("id", 25) * 1400 * DAY).cast("long")).alias("created_at"))
        p = products()
        goods = p.select(F.col("id").alias("product_id"), "cost", *(F.col(c).alias(f"product_{c}") for c in ("category", "name", "brand", "retail_price", "department", "sku", "distribution_center_id")))
        return shaped(sold.unionByName(left).join(goods, "product_id"), "inventory_items")

    def events():
        # sessions of 2 to 8 events, cut at 20,000
        s = spark.range(1, 6001).withColumn("size", F.lit(2) + (draw("id", 26) * 7).cast("int"))
        rows = s.select(F.col("id").alias("s"), "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("sequence_number"))
        rows = rows.withColumn("n", F.row_number().over(Window.orderBy("s", "sequence_number")).cast("long")).where("n <= 20000")
        user = (draw("s", 27) * 400).cast("long") + 1
        signed = users().select(F.col("id").alias("user_id"), F.unix_seconds("created_at").alias("signed"))
        last = F.when(F.col("sequence_number") < F.col("size"), F.when(F.col("sequence_number") == F.col("size") - 1, "cart").otherwise("product")).otherwise(F.when(draw("s", 28) < 0.7, "purchase").otherwise("cancel"))
        kind = F.when(F.col("sequence_number") == 1, "home").when(F.col("sequence_number") == 2, "department").when(F.col("size") >= 5, last).otherwise("product")
        rows = rows.withColumn("user_id", user).join(signed, "user_id")
        begin = F.col("signed") + 60 + (draw("s", 29) * 60 * DAY).cast("long")
        return shaped(rows.withColumns({"id": F.col("n"), "session_id": F.md5(F.col("s").cast("string")), "created_at": at(begin + F.col("sequence_number") * 45), "browser": pick(["Chrome", "Firefox", "Safari"], "s", 30), "traffic_source": pick(EVENT_CHANNELS, "s", 31), "event_type": kind, "uri": F.concat(F.lit("/"), kind)}), "events")

    made = {"distribution_centers": centers, "products": products, "users": users, "orders": orders, "order_items": order_items, "inventory_items": inventory_items, "events": events}
    assert set(made) == set(SCHEMAS)
    return Source(made)
