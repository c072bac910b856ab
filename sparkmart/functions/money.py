"""Money is decimal(38,9). A difference of two such values has too few digits unless both are narrowed first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casting import column
from .types import INT, MONEY, decimal_type


def money(c: Column | str) -> Column:
    return column(c).cast(MONEY)


def minus(a: Column | str, b: Column | str) -> Column:
    """a - b without the loss of the ninth decimal."""
    narrow = decimal_type(37, 9)
    return (column(a).cast(narrow) - column(b).cast(narrow)).cast(MONEY)


def quotient(amount: Column | str, count: Column | str) -> Column:
    """Money over a whole number, rounded half away from zero to nine decimals; null over zero."""
    return (money(amount) / F.nullif(column(count).cast(INT), F.lit(0).cast(INT))).cast(MONEY)


def round_money(c: Column, places: int = 2) -> Column:
    return F.round(c, places).cast(MONEY)


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """A double; null over zero or null."""
    return column(a).cast("double") / F.nullif(column(b).cast("double"), F.lit(0.0))
