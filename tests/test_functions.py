"""Each function on constants with known results."""

import datetime as d
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from sparkmart import functions as fn

T = d.datetime


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def day(text):
    return F.lit(text).cast("date")


CASES = {
    "safe_cast": (lambda: fn.safe_cast(F.lit("42"), fn.INT), 42),
    "safe_cast fails": (lambda: fn.safe_cast(F.lit("nope"), fn.INT), None),
    "safe_cast of a fraction": (lambda: fn.safe_cast(F.lit("4.2"), fn.INT), None),
    "safe_cast of spaces": (lambda: fn.safe_cast(F.lit(" 42 "), fn.INT), 42),
    "to_text": (lambda: fn.to_text(F.lit(7)), "7"),
    "to_utc": (lambda: fn.to_utc(F.lit("2024-03-15 13:45:00+02").cast("timestamp")), T(2024, 3, 15, 11, 45)),
    "safe_divide": (lambda: fn.safe_divide(F.lit(1), F.lit(4)), 0.25),
    "safe_divide by 0": (lambda: fn.safe_divide(F.lit(1), F.lit(0)), None),
    "safe_divide by null": (lambda: fn.safe_divide(F.lit(1), F.lit(None)), None),
    "quotient": (lambda: fn.quotient(F.lit("191.249999999").cast(fn.MONEY), F.lit(2)), Decimal("95.625000000")),
    "quotient negated": (lambda: fn.quotient(F.lit("-191.249999999").cast(fn.MONEY), F.lit(2)), Decimal("-95.625000000")),
    "quotient by 0": (lambda: fn.quotient(F.lit("191.249999999").cast(fn.MONEY), F.lit(0)), None),
    "rounded quotient": (lambda: fn.round_money(fn.quotient(F.lit("191.249999999").cast(fn.MONEY), F.lit(2))), Decimal("95.630000000")),
    "money of a double": (lambda: fn.money(F.lit(6.644999999552965)), Decimal("6.645000000")),
    "minus keeps nine decimals": (lambda: fn.minus(F.lit("1.000000001").cast(fn.MONEY), F.lit("0.000000002").cast(fn.MONEY)), Decimal("0.999999999")),
    "days": (lambda: fn.days_between(day("2024-03-15"), day("2024-03-01")), 14),
    "days swapped": (lambda: fn.days_between(day("2024-03-01"), day("2024-03-15")), -14),
    "month text": (lambda: fn.format_month(day("2024-03-15")), "2024-03"),
    "slashed": (lambda: fn.format_date(day("2024-03-15"), "%Y/%m/%d"), "2024/03/15"),
    "day of year": (lambda: fn.format_date(day("2024-03-15"), "%j"), "075"),
    "names": (lambda: fn.format_date(day("2024-03-15"), "%a %b"), "Fri Mar"),
    "literal letters": (lambda: fn.format_date(day("2024-03-15"), "day %d"), "day 15"),
    "hour": (lambda: fn.trunc_to(ts("2024-03-15 13:45:12"), "hour"), T(2024, 3, 15, 13)),
    "week": (lambda: fn.trunc_to(ts("2024-03-15 13:45:12"), "week"), T(2024, 3, 11)),
    "quarter": (lambda: fn.trunc_to(ts("2024-03-15 13:45:12"), "quarter"), T(2024, 1, 1)),
    "friday": (lambda: fn.day_of_week_iso(day("2024-03-15")), 5),
    "sunday": (lambda: fn.day_of_week_iso(day("2024-03-17")), 7),
    "monday": (lambda: fn.day_of_week_iso(day("2024-03-11")), 1),
    "month start": (lambda: fn.month_start(ts("2024-03-15 13:45:12")), T(2024, 3, 1)),
    "month number": (lambda: fn.month_number(ts("2024-03-15 13:45:12")), 202403),
    "seconds": (lambda: fn.seconds_between(ts("2024-03-15 00:00:00"), ts("2024-03-15 00:01:30.5")), 90.5),
    "two microseconds": (lambda: fn.seconds_between(ts("2024-03-15 00:00:00"), ts("2024-03-15 00:00:00.000002")), 2.0e-6),
    "four years": (lambda: fn.seconds_between(ts("2020-01-01 00:00:00"), ts("2024-01-01 00:00:00.000001")), 126230400.000001),
    "series": (lambda: fn.int_series(1, 5), [1, 2, 3, 4, 5]),
    "series by three": (lambda: fn.int_series(1, 9, 3), [1, 4, 7]),
    "series of none": (lambda: fn.int_series(5, 1), []),
    "series down": (lambda: fn.int_series(5, 1, -2), [5, 3, 1]),
    "days' series": (lambda: fn.date_series(day("2024-03-01"), day("2024-03-03")), [d.date(2024, 3, k) for k in (1, 2, 3)]),
    "months don't drift": (lambda: fn.date_series(day("2024-01-31"), day("2024-04-30"), "1 month"), [d.date(2024, 1, 31), d.date(2024, 2, 29), d.date(2024, 3, 31), d.date(2024, 4, 30)]),
    "quarters": (lambda: F.size(fn.date_series(day("2023-01-01"), day("2024-01-01"), "1 quarter")), 5),
    "weeks": (lambda: F.size(fn.date_series(day("2024-01-01"), day("2024-01-29"), "2 weeks")), 3),
    "no dates": (lambda: fn.date_series(day("2024-03-03"), day("2024-03-01")), []),
    "found at the start": (lambda: fn.matches(F.lit("StarDust"), "^Star"), True),
    "not found": (lambda: fn.matches(F.lit("StarDust"), "^Nope"), False),
    "found within": (lambda: fn.matches(F.lit("StarDust"), "Dust"), True),
    "json": (lambda: fn.json_value(fn.struct_of(("a", 1), ("b", 2))), '{"a":1,"b":2}'),
    "json null": (lambda: fn.json_value(fn.struct_of(("a", None, fn.INT))), '{"a":null}'),
    "key": (lambda: fn.surrogate_key(F.lit(1), F.lit("x")), "df6729622b8fb993f31b1ba95a27e5cc"),
    "key without nulls": (lambda: fn.surrogate_key(F.lit(1), F.lit(None), F.lit("x")), "df6729622b8fb993f31b1ba95a27e5cc"),
}


def test_values(spark):
    names = list(CASES)
    row = spark.range(1).select(*(CASES[n][0]().alias(f"c{i}") for i, n in enumerate(names))).first()
    wrong = {n: (row[i], CASES[n][1]) for i, n in enumerate(names) if row[i] != CASES[n][1]}
    assert not wrong


def test_types(spark):
    m = F.lit("1").cast(fn.MONEY)
    kinds = dict(spark.range(1).select(fn.quotient(m, F.lit(3)).alias("q"), fn.minus(m, m).alias("m"), fn.days_between(day("2024-01-01"), day("2024-01-01")).alias("d"), fn.month_start(ts("2024-01-01")).alias("t"), fn.int_series(1, 2).alias("s")).dtypes)
    assert kinds == {"q": "decimal(38,9)", "m": "decimal(38,9)", "d": "bigint", "t": "timestamp_ntz", "s": "array<bigint>"}


@pytest.mark.parametrize(
    "bad",
    [
        lambda: fn.decimal_type(39, 2), lambda: fn.decimal_type(0, 0), lambda: fn.decimal_type(5, 6), lambda: fn.decimal_type("5", 2), lambda: fn.trunc_to(F.lit(1), "decade"), lambda: fn.format_date(F.lit(1), "%Q"),
        lambda: fn.format_date(F.lit(1), "%"), lambda: fn.int_series(1, 2, 0), lambda: fn.date_series(F.lit(1), F.lit(2), "0 day"), lambda: fn.date_series(F.lit(1), F.lit(2), "1 hour"), lambda: fn.struct_of(),
        lambda: fn.struct_of(("a", 1), ("a", 2)), lambda: fn.struct_of(("a b", 1)), lambda: fn.surrogate_key(), lambda: fn.matches(F.lit("x"), "(?=x)"), lambda: fn.unnest(F.lit(1), "a b"), lambda: fn.physical_layout(grain="hour"),
    ],
)
def test_refusals(spark, bad):
    with pytest.raises(ValueError):
        bad()


def test_all_but(spark):
    df = spark.range(1).selectExpr("id", "1 as a", "2 as b")
    assert fn.all_but(df, "a").columns == ["id", "b"]
    for names in ((), ("c",)):
        with pytest.raises(ValueError):
            fn.all_but(df, *names)


def test_unnest_leaves_out_null_and_empty_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id long, a array<long>")
    assert sorted(map(tuple, df.select("id", fn.unnest("a", "x")).collect())) == [(1, 1), (1, 2)]


def test_quotients_are_exact(spark):
    rng = random.Random(1)
    rows = [(Decimal(rng.randint(-(10**15), 10**15)).scaleb(-9), rng.choice([-1, 1]) * rng.randint(1, 10**5)) for _ in range(3000)]
    rows += [(Decimal(2 * k + 1).scaleb(-9), 2) for k in range(-500, 500)]  # half-way cases
    got = spark.createDataFrame(rows, "n decimal(38,9), d long").select("n", "d", fn.quotient("n", "d").alias("q")).collect()
    assert all(r["q"] == (r["n"] / r["d"]).quantize(Decimal("1e-9"), ROUND_HALF_UP) for r in got)
