"""Proof that two builds hold the same values: digests that don't depend on order, profiles, keyed differences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind(t: T.DataType) -> str:
    """int, float, bool, date, timestamp, string, decimal, bytes, array<...> or struct<...>: what engines call by different names."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(t, T.ArrayType):
        return f"array<{kind(t.elementType)}>"
    if isinstance(t, T.StructType):
        return f"struct<{','.join(f'{f.name}:{kind(f.dataType)}' for f in t)}>"
    names = {T.BooleanType: "bool", T.DateType: "date", T.StringType: "string", T.BinaryType: "bytes"}
    for cls, name in names.items():
        if isinstance(t, cls):
            return name
    raise TypeError(f"no kind for {t.simpleString()}")


def canonical(c: Column, t: T.DataType) -> Column:
    """Text that equal values have in common, whatever the engine's rendering; null stays null.

    Decimals lose zeros at their end, floats are whole millionths, times microseconds since 1970; arrays are
    sorted and joined, structs go field by field.
    """
    k = kind(t)
    if k == "decimal":
        text = c.cast("string")
        return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    if k == "float":
        wide = F.round(c.cast("double") * 1e6)
        small = F.abs(wide) < 9e18
        return F.when(F.isnan(c), "nan").when(small, F.when(small, wide).cast("long").cast("string")).otherwise(c.cast("double").cast("string"))
    if k == "timestamp":
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if k == "bool":
        return F.when(c, "true").when(~c, "false")
    if k == "bytes":
        return F.hex(c)
    if isinstance(t, T.ArrayType):
        parts = F.transform(c, lambda x: F.coalesce(canonical(x, t.elementType), F.lit("<null>")))
        return F.array_join(F.array_sort(parts), ",")
    if isinstance(t, T.StructType):
        fields = [F.concat(F.lit(f"{f.name}="), F.coalesce(canonical(c[f.name], f.dataType), F.lit("<null>"))) for f in t]
        return F.when(c.isNotNull(), F.concat_ws(";", *fields))
    return c.cast("string")


def digest(text: Column) -> Column:
    """A sum, over rows in any order, of the first 32 bits of each text's MD5."""
    return F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))


def metrics(df: DataFrame) -> DataFrame:
    """(column_name, kind, n_rows, n_nulls, digest, n_distinct) of each column, in one scan.

    Equal texts of a column are counted before they are dealt out and hashed, so distinct values cost what there are of them.
    """
    columns = df.sparkSession.createDataFrame([(i, f.name, kind(f.dataType)) for i, f in enumerate(df.schema)], "i int, column_name string, kind string")
    cells = F.array(*(F.struct(F.lit(i).alias("i"), canonical(F.col(f"`{f.name}`"), f.dataType).alias("t")) for i, f in enumerate(df.schema)))
    texts = df.select(F.explode(cells).alias("x")).groupBy(F.col("x.i").alias("c"), F.col("x.t").alias("t")).agg(F.count("*").alias("n"))
    first = F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long")
    each = texts.groupBy("c").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("t").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"), F.sum(first * F.col("n")).alias("digest"), F.count("t").alias("n_distinct"))
    found = columns.join(F.broadcast(each), F.col("i") == F.col("c"), "left")  # a row per column
    return found.select("column_name", "kind", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rows", "n_nulls", "digest", "n_distinct")))


@dataclass
class Verdict:
    same: bool
    differences: list[str]


def verdict(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> Verdict:
    """Whether two relations agree in columns, order, kinds, rows and each column's metrics (a row per column is read)."""
    out = []
    if a.columns != b.columns:
        out.append("columns" if sorted(a.columns) != sorted(b.columns) else "order of columns")
    left, right = ({r["column_name"]: r.asDict() for r in metrics(x).collect()} for x in (a, b))
    for name in left.keys() & right.keys():
        out += [f"{name}: {k}" for k in ("kind", "n_rows", "n_nulls", "digest", "n_distinct") if left[name][k] != right[name][k] and name not in ignore]
    return Verdict(not out, sorted(out))


def profile(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_values, n_distinct, total, low, high) as text: sums are exact for numbers, lengths for texts."""
    aggs, rows = [F.count("*").alias("n")], []
    for i, f in enumerate(df.schema):
        c, k = F.col(f"`{f.name}`"), kind(f.dataType)
        number = {"int": c.cast("decimal(38,0)"), "decimal": c, "float": F.round(c * 1000000).cast("decimal(38,0)"), "bool": c.cast("int").cast("decimal(38,0)"), "string": F.length(c).cast("decimal(38,0)"), "date": F.unix_date(c).cast("decimal(38,0)"), "timestamp": (F.unix_micros(c.cast("timestamp")) / 1000000).cast("decimal(38,6)")}.get(k)
        if k.startswith("array"):
            number = F.size(c).cast("decimal(38,0)")
        plain = canonical(c, f.dataType)
        ordered = c if k in ("int", "decimal", "date", "timestamp", "string") else None
        none = F.lit(None).cast("string")
        aggs += [F.count(c).alias(f"c{i}"), F.countDistinct(plain).alias(f"u{i}"), (canonical(F.sum(number), T.DecimalType(38, 9)) if number is not None else none).alias(f"s{i}")]
        aggs += [(canonical(F.min(ordered), f.dataType) if ordered is not None else F.max(none)).alias(f"l{i}"), (canonical(F.max(ordered), f.dataType) if ordered is not None else F.max(none)).alias(f"h{i}")]
        rows.append(F.struct(F.lit(f.name).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"c{i}").alias("n_values"), F.col(f"u{i}").alias("n_distinct"), F.col(f"s{i}").alias("total"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def close(a: str | None, b: str | None, float_kind: bool = False) -> bool:
    """Whether two profile values agree: text for text, doubles to nine digits."""
    if a is None or b is None or not float_kind:
        return a == b
    x, y = float(a), float(b)
    return abs(x - y) <= 1e-9 * max(abs(x), abs(y), 1.0)


def row_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(column_name, identical, equivalent, different, only_left, only_right, example): cell classes of a keyed full outer join.

    Cells are identical if they are equal without a null, or both null; equivalent if their canonical texts
    are equal (other type, scale or zone); else different. Keys must be unique and not null; see `repeated_keys`.
    The example is the least key with a different cell.
    """
    shared = [c for c in left.columns if c in right.columns and c != key]
    lt, rt = dict(zip(left.columns, left.schema)), dict(zip(right.columns, right.schema))
    a = left.select(F.col(key).alias("k"), F.lit(True).alias("in_left"), *(F.col(c).alias(f"l{i}") for i, c in enumerate(shared)))
    b = right.select(F.col(key).alias("k"), F.lit(True).alias("in_right"), *(F.col(c).alias(f"r{i}") for i, c in enumerate(shared)))
    both = a.join(b, "k", "full")
    here = F.col("in_left") & F.col("in_right")
    aggs = [F.count_if(F.col("in_right").isNull()).alias("only_left"), F.count_if(F.col("in_left").isNull()).alias("only_right")]
    rows = []
    for i, c in enumerate(shared):
        x, y = F.col(f"l{i}"), F.col(f"r{i}")
        one_type = lt[c].dataType == rt[c].dataType
        same = x.eqNullSafe(y) if one_type else F.lit(False)
        like = canonical(x, lt[c].dataType).eqNullSafe(canonical(y, rt[c].dataType))
        other = here & ~same & ~like
        aggs += [F.count_if(here & same).alias(f"i{i}"), F.count_if(here & ~same & like).alias(f"e{i}"), F.count_if(other).alias(f"d{i}"), F.min(F.when(other, F.col("k"))).alias(f"x{i}")]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col(f"i{i}").alias("identical"), F.col(f"e{i}").alias("equivalent"), F.col(f"d{i}").alias("different"), F.col("only_left"), F.col("only_right"), F.col(f"x{i}").cast("string").alias("example")))
    return both.agg(*aggs).select(F.inline(F.array(*rows)))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def rendered(left: DataFrame, right: DataFrame, key: str, n: int = 100) -> DataFrame:
    """How both sides print the cells of the first n keys that differ in text."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    first = left.select(key).orderBy(F.col(key).asc_nulls_last()).limit(n)
    long = lambda df, name: df.join(first, key, "left_semi").select(F.col(key), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias(name)) for c in shared))).alias("x")).select(key, "x.column_name", f"x.{name}")
    return long(left, "l").join(long(right, "r"), [key, "column_name"], "full").where(~F.col("l").eqNullSafe(F.col("r")))


def scale_attribution(base: DataFrame, wide: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """(bucket, n, worst): why a money column differs between three builds.

    base: two decimals; wide: the same engine with nine; other: the other engine. identical: base equals other; A: rounding
    wide to cents gives base, and wide equals other (scale alone); B: wide differs from other by less than a cent (arithmetic); C: the rest.
    """
    t = [df.select(F.col(key).alias("k"), F.col(column).cast("decimal(37,9)").alias(n)) for df, n in ((base, "base"), (wide, "wide"), (other, "other"))]
    rows = t[0].join(t[1], "k", "full").join(t[2], "k", "full")
    gap = F.coalesce(F.abs(F.col("wide") - F.col("other")), F.lit(0))
    bucket = (
        F.when(F.col("base").eqNullSafe(F.col("other")), "identical")
        .when(F.col("wide").eqNullSafe(F.col("other")) & F.round("wide", 2).eqNullSafe(F.round("base", 2)), "A")
        .when(F.col("wide").isNotNull() & F.col("other").isNotNull() & (gap < 0.01), "B")
        .otherwise("C")
    )
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max(gap).cast("decimal(38,9)").alias("worst"))


def delta_histogram(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """(delta, n): by how much a money column differs, where it does."""
    a = left.select(F.col(key).alias("k"), F.col(column).cast("decimal(37,9)").alias("l"))
    b = right.select(F.col(key).alias("k"), F.col(column).cast("decimal(37,9)").alias("r"))
    delta = (F.col("l") - F.col("r")).cast("decimal(38,9)")
    return a.join(b, "k").where(~F.col("l").eqNullSafe(F.col("r"))).groupBy(delta.alias("delta")).agg(F.count("*").alias("n"))


def two_step_rounding(df: DataFrame, column: str) -> DataFrame:
    """Rows whose cents depend on whether a double is rounded at once or by way of nine decimals."""
    at_once, by_way = F.col(column).cast("decimal(18,2)"), F.round(F.col(column).cast("decimal(38,9)"), 2).cast("decimal(18,2)")
    return df.where(~at_once.eqNullSafe(by_way)).select(column, at_once.alias("at_once"), by_way.alias("by_way"))


def schema_diff(a: T.StructType, b: T.StructType) -> list[str]:
    """Columns that only one side has, and columns of another kind."""
    left, right = ({f.name: f.dataType for f in s} for s in (a, b))
    out = [f"only left: {n}" for n in left if n not in right] + [f"only right: {n}" for n in right if n not in left]
    return out + [f"{n}: {kind(left[n])} and {kind(right[n])}" for n in left if n in right and kind(left[n]) != kind(right[n])]
