"""Files in and out: Parquet, CSV, JSON lines, ordered and sharded exports, partitioned layouts, and what a scan reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space at the ends of a text is kept.
CSV = {"header": True, "nullValue": "\\N", "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_parquet(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None, with_file: bool = False) -> DataFrame:
    """Files, folders or globs; with_file adds `filename`."""
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(*paths)
    return df.select("*", F.col("_metadata.file_name").alias("filename")) if with_file else df


def rows_per_file(spark: SparkSession, *paths: str) -> DataFrame:
    return read_parquet(spark, *paths, with_file=True).groupBy("filename").agg(F.count("*").alias("n_rows"))


def columns_of(df: DataFrame) -> DataFrame:
    """(column_name, type) in order, as a relation."""
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "position int, column_name string, type string")


def texts(df: DataFrame) -> DataFrame:
    """Columns that a text file can't hold, as text: nested ones as JSON, bytes in hex, decimals and times as they print."""

    def text(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(c, {"ignoreNullFields": "false"}).alias(f.name)
        if isinstance(f.dataType, T.BinaryType):
            return F.hex(c).alias(f.name)
        if isinstance(f.dataType, (T.DecimalType, T.TimestampType, T.TimestampNTZType)):
            return c.cast("string").alias(f.name)
        return c

    return df.select(*(text(f) for f in df.schema))


def write_csv(df: DataFrame, path: str) -> None:
    r"""A header, and \N for null; Spark itself refuses nested columns, which `texts` makes text before."""
    texts(df).write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The declared types, from files of `write_csv`; nothing is inferred."""
    plain = (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.BooleanType, T.DateType)
    raw = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, plain) else T.StringType()) for f in schema])
    df = spark.read.options(**CSV).schema(raw).csv(path)

    def back(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.from_json(c, f.dataType).alias(f.name)
        return (F.unhex(c) if isinstance(f.dataType, T.BinaryType) else c.cast(f.dataType)).alias(f.name)

    return df.select(*(back(f) for f in schema))


def export(df: DataFrame, path: str, shards: int | None = None, order: list[str] | None = None, kind: str = "parquet") -> None:
    """Unordered shards, or files in a total order: the sort is by ranges, so a large export is many files whose names follow the order."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"no such kind of export: {kind!r}")
    if order:
        df = df.repartitionByRange(shards or 1, *order).sortWithinPartitions(*order)
    elif shards:
        df = df.repartition(shards)
    getattr(df.write.mode("overwrite"), kind)(path)


def export_tagged(path: str, **tables: DataFrame) -> None:
    """Several tables of one schema under one path, a folder each, rather than a union that must be told apart again."""
    out = None
    for name, df in tables.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    out.write.mode("overwrite").partitionBy("source").parquet(path)


def create_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def land(spark: SparkSession, path: str, name: str, instants: tuple[str, ...] = ()) -> int:
    """A Parquet table as a catalog table: the rows are counted before and after; wall clocks where instants are declared are refused."""
    df = spark.read.parquet(path)
    naive = [f.name for f in df.schema if f.name in instants and isinstance(f.dataType, T.TimestampNTZType)]
    if naive:
        raise TypeError(f"these are wall clocks, not instants: {', '.join(naive)}")
    n = df.count()
    create_table(df, name)
    if spark.table(name).count() != n:
        raise RuntimeError(f"{name} doesn't hold the {n} rows of {path}")
    return n


def as_instants(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Wall clocks as instants in UTC, and the rows whose microseconds would have changed (none)."""
    out = df.withColumns({c: F.col(c).cast("timestamp") for c in columns})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    moved = df.where(" or ".join("false" for _ in columns) or "false")
    for c in columns:
        moved = moved.unionByName(df.where(~micros(c).eqNullSafe(F.unix_micros(F.to_utc_timestamp(F.col(c).cast("timestamp"), "UTC")))))
    return out, moved


def row_order(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """(n_rows, descents, first, last, sequence_md5): whether rows stand in the order of a column.

    The sequence is that of `position`, a column that the caller gives; a window over all rows and one long text can't be
    spread, so this is for samples of a bounded size.
    """
    from pyspark.sql import Window

    w = Window.orderBy("position")
    rows = df.withColumn("before", F.lag(by).over(w))
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in columns or (by,)))
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(by) < F.col("before")).alias("descents"), F.min(by).alias("first"), F.max(by).alias("last"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", text.alias("t")))), lambda x: x["t"]), ",")).alias("sequence_md5"),
    )


def export_order(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(filename, n_rows, descents, first, last, sequence_sum) of each file of an ordered Parquet export, in the order of names.

    descents: within the file, and one more if its first row is below the last row of the file before. sequence_sum:
    the sum of place * XXH64 of the column, places from 1 in each file. No window is over more than a file's rows or
    one row a file.
    """
    from pyspark.sql import Window

    rows = spark.read.parquet(path).select(F.col(by).alias("x"), F.col("_metadata.file_name").alias("filename"), F.col("_metadata.row_index").alias("place"))
    rows = rows.withColumn("before", F.lag("x").over(Window.partitionBy("filename").orderBy("place")))
    ends = rows.groupBy("filename").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("x") < F.col("before")).alias("inside"), F.min_by("x", "place").alias("first"), F.max_by("x", "place").alias("last"),
        F.sum((F.col("place") + 1).cast("decimal(18,0)") * F.xxhash64("x").cast("decimal(20,0)")).alias("sequence_sum"),
    )
    step = F.coalesce((F.col("first") < F.lag("last").over(Window.orderBy("filename"))).cast("long"), F.lit(0))
    return ends.select("filename", "n_rows", (F.col("inside") + step).alias("descents"), "first", "last", "sequence_sum")


def scanned(df: DataFrame) -> dict[str, int]:
    """Files and partitions that a scan of this plan reads, from its inputs: pruned folders aren't in it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {"files": len(df.inputFiles()), "partition_filters": plan.count("PartitionFilters: [") - plan.count("PartitionFilters: []"), "pushed": plan.count("PushedFilters: [") - plan.count("PushedFilters: []")}


def estimated_bytes(df: DataFrame) -> int:
    """What the optimiser believes a query reads and makes: a dry run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def guarded(df: DataFrame, limit: int) -> DataFrame:
    """The query, refused if it is estimated to be above the limit."""
    if (n := estimated_bytes(df)) > limit:
        raise RuntimeError(f"the query is estimated at {n} bytes; the limit is {limit}")
    return df


def insert_rows(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Appends rows to a catalog table, by column name."""
    df.select(*spark.table(name).columns).write.insertInto(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {'.'.join(f'`{p}`' for p in name.split('.'))}")


def remote_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query that another database runs, by JDBC; filters and columns asked of the result are pushed to it. Its driver must be on the class path."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def remote_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of another database, read in ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        if bounds is None:
            raise ValueError("a key needs bounds")
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def partition_summary(df: DataFrame, partition: str, key: str) -> DataFrame:
    """(partition, n_rows, first, last): rows and the range of a key in each partition, the one for null too."""
    return df.groupBy(F.col(partition).cast("string").alias("partition")).agg(F.count("*").alias("n_rows"), F.min(key).alias("first"), F.max(key).alias("last"))
