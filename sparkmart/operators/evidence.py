"""Evidence beside the verdicts of `verify`: examples, invariants, lineage, repeated builds and recorded sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import MONEY
from .verify import canonical, kind, metrics, repeated_keys, row_diff


def first_k(df: DataFrame, by: str, k: int, *order: str) -> DataFrame:
    """The first k rows of each value of `by`, with their place; each task passes on k rows a value."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def examples(left: DataFrame, right: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(column_name, place, key, left_text, right_text): the k least keys of each column whose cells differ in canonical text."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    lt, rt = dict(zip(left.columns, left.schema)), dict(zip(right.columns, right.schema))
    a = left.select(F.col(key).alias("k"), *(canonical(F.col(c), lt[c].dataType).alias(f"l{i}") for i, c in enumerate(shared)))
    b = right.select(F.col(key).alias("k"), *(canonical(F.col(c), rt[c].dataType).alias(f"r{i}") for i, c in enumerate(shared)))
    cells = [F.when(~F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")), F.struct(F.lit(c).alias("column_name"), F.col(f"l{i}").alias("left_text"), F.col(f"r{i}").alias("right_text"))) for i, c in enumerate(shared)]
    rows = a.join(b, "k").select("k", F.explode(F.array_compact(F.array(*cells))).alias("x")).select("k", "x.*")
    return first_k(rows, "column_name", k, "k").select("column_name", "place", F.col("k").cast("string").alias("key"), "left_text", "right_text")


def unrepeated(df: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not null and stands in one row only."""
    return df.where(F.col(key).isNotNull()).join(repeated_keys(df, key).where(F.col(key).isNotNull()).select(key), key, "left_anti")


def row_diff_apart(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """`row_diff` of the rows whose keys are their own on both sides, with the numbers of keys that aren't (repeated_left, repeated_right)."""
    rep = [repeated_keys(x, key).select(F.col(key).alias("rep")) for x in (left, right)]
    counts = [r.agg(F.count("*").alias(n)) for r, n in zip(rep, ("repeated_left", "repeated_right"))]
    sides = [unrepeated(x, key).join(other.where("rep is not null"), F.col(key) == F.col("rep"), "left_anti") for x, other in zip((left, right), rep[::-1])]
    return row_diff(*sides, key).crossJoin(F.broadcast(counts[0])).crossJoin(F.broadcast(counts[1]))  # relations of one row


def attributed(base: DataFrame, wide: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """(key, base, wide, other, bucket) of every row; see `verify.scale_attribution` for the buckets."""
    t = [df.select(F.col(key).alias("key"), F.col(column).cast("decimal(37,9)").alias(n)) for df, n in ((base, "base"), (wide, "wide"), (other, "other"))]
    gap = F.coalesce(F.abs(F.col("wide") - F.col("other")), F.lit(0))
    bucket = (
        F.when(F.col("base").eqNullSafe(F.col("other")), "identical")
        .when(F.col("wide").eqNullSafe(F.col("other")) & F.round("wide", 2).eqNullSafe(F.round("base", 2)), "A")
        .when(F.col("wide").isNotNull() & F.col("other").isNotNull() & (gap < 0.01), "B")
        .otherwise("C")
    )
    return t[0].join(t[1], "key", "full").join(t[2], "key", "full").withColumn("bucket", bucket)


def invariants(rows: DataFrame) -> DataFrame:
    """(invariant, violations) of `attributed` rows: what must hold if the buckets say why a column differs."""
    cents = F.round("wide", 2)
    broken = {
        "every row has a bucket": F.col("bucket").isNull(),
        "every key has all three legs": F.col("base").isNull() | F.col("wide").isNull() | F.col("other").isNull(),
        "the base leg holds whole cents": ~F.round("base", 2).eqNullSafe(F.col("base")),
        "the wide leg rounds to the base": ~cents.eqNullSafe(F.col("base")),
        "an A row differs by less than a cent": (F.col("bucket") == "A") & (F.abs(F.col("base") - F.col("other")) >= 0.01),
    }
    got = rows.agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(broken.values())))
    return got.select(F.inline(F.array(*(F.struct(F.lit(n).alias("invariant"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(broken)))))


def lineage(rows: DataFrame, raw: DataFrame, key: str, value: Column) -> DataFrame:
    """(agrees_with, n): which leg the value recomputed from its raw source gives, for `attributed` rows of bucket C."""
    again = raw.select(F.col(key).alias("key"), value.cast("decimal(37,9)").alias("again"))
    both = rows.where("bucket = 'C'").join(again, "key", "left")
    wide, other = F.col("wide").eqNullSafe(F.col("again")), F.col("other").eqNullSafe(F.col("again"))
    which = F.when(wide & other, "both").when(wide, "wide").when(other, "other").otherwise("neither")
    return both.groupBy(which.alias("agrees_with")).agg(F.count("*").alias("n"))


def repeated_builds(build: Callable[[], DataFrame]) -> DataFrame:
    """(column_name, same): whether two builds agree in each column's rows, nulls, digest and distinct values."""
    a, b = (metrics(build()) for _ in range(2))
    names = ("kind", "n_rows", "n_nulls", "digest", "n_distinct")
    both = a.select("column_name", F.struct(*names).alias("a")).join(b.select(F.col("column_name").alias("c"), F.struct(*names).alias("b")), F.col("column_name") == F.col("c"), "full")
    return both.select(F.coalesce("column_name", "c").alias("column_name"), F.col("a").eqNullSafe(F.col("b")).alias("same"))


def scale_columns(narrow: DataFrame, wide: DataFrame, digits: int = 2) -> DataFrame:
    """(column_name, same, same_rounded) of the decimal columns: whether scale alone keeps two builds' digests apart."""
    money = [f.name for f in wide.schema if isinstance(f.dataType, T.DecimalType) and f.name in narrow.columns]
    if not money:
        raise ValueError("no decimal columns")
    legs = (narrow.select(*money), wide.select(*money), wide.select(*(F.round(c, digits).alias(c) for c in money)))
    got = [metrics(x).select("column_name", F.struct("n_rows", "n_nulls", "digest").alias(n)) for x, n in zip(legs, "nwr")]
    both = got[0].join(got[1], "column_name").join(got[2], "column_name")
    return both.select("column_name", (F.col("n") == F.col("w")).alias("same"), (F.col("n") == F.col("r")).alias("same_rounded"))


def recorded(tables: dict[str, DataFrame], money: dict[str, list[str]]) -> DataFrame:
    """(relation, column_name, n_rows, digest): rows and the digest of each money column of raw sources, to be stored and held against later."""
    out = None
    for name, df in tables.items():
        one = metrics(df.select(*(F.col(c).cast(MONEY).alias(c) for c in money[name]))).select(F.lit(name).alias("relation"), "column_name", "n_rows", "digest")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def source_gate(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(relation, column_name, ok): whether sources still hold what was recorded; what only one side has isn't ok."""
    a = stored.select("relation", "column_name", F.struct("n_rows", "digest").alias("a"))
    b = found.select("relation", "column_name", F.struct("n_rows", "digest").alias("b"))
    return a.join(b, ["relation", "column_name"], "full").select("relation", "column_name", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("ok"))


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts hold the same value: keys in any order, any white space; a text that isn't JSON equals itself alone."""
    x, y = (F.to_json(F.try_parse_json(c)) for c in (a, b))
    return F.when(x.isNull() | y.isNull(), a.eqNullSafe(b)).otherwise(x == y)


def tolerant(a: Column, b: Column, t: T.DataType, json: bool = False) -> Column:
    """Whether two values are equal as their kind has it; two nulls are, and null and another value are not.

    Decimals by value, doubles to nine digits (nan equals nan), times by microseconds, JSON as parsed, bytes in any case of hex, else canonical text.
    """
    k = kind(t)
    if json:
        same = json_equal(a, b)
    elif k == "decimal":
        same = a.cast("decimal(38,9)") == b.cast("decimal(38,9)")
    elif k == "float":
        x, y = a.cast("double"), b.cast("double")
        same = (F.isnan(x) & F.isnan(y)) | (F.abs(x - y) <= F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) * 1e-9)
    elif k == "timestamp":
        same = F.unix_micros(a.cast("timestamp")) == F.unix_micros(b.cast("timestamp"))
    elif k == "bytes":
        same = F.upper(F.hex(a)) == F.upper(b.cast("string"))
    else:
        same = canonical(a, t) == canonical(b, t)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)
