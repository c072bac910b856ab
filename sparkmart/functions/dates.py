from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casting import column
from .types import INT, TIMESTAMP

GRAINS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
#: strftime codes and the patterns that Spark has for them.
CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%j": "DDD", "%a": "EEE", "%b": "MMM"}


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days from earlier to later, negative if they are swapped."""
    return F.date_diff(column(later), column(earlier)).cast(INT)


def format_date(c: Column | str, code: str) -> Column:
    """Text by strftime codes; a code without a counterpart is refused."""
    out = []
    for piece in re.findall(r"%.|[^%]+|%$", code):
        if piece.startswith("%"):
            if piece not in CODES:
                raise ValueError(f"no such date code: {piece!r}; there are {', '.join(CODES)}")
            out.append(CODES[piece])
        else:
            out.append(re.sub("[A-Za-z]+", r"'\g<0>'", piece.replace("'", "''")))
    return F.date_format(column(c), "".join(out))


def format_month(c: Column | str) -> Column:
    return format_date(c, "%Y-%m")


def trunc_to(c: Column | str, grain: str) -> Column:
    """The beginning of the second, ..., year; weeks begin on Monday."""
    if grain not in GRAINS:
        raise ValueError(f"no such grain: {grain!r}; there are {', '.join(GRAINS)}")
    return F.date_trunc(grain, column(c)).cast(TIMESTAMP)


def day_of_week_iso(c: Column | str) -> Column:
    """Monday is 1, Sunday 7."""
    return (F.weekday(column(c)) + 1).cast(INT)


def month_start(c: Column | str) -> Column:
    return trunc_to(c, "month")


def month_number(c: Column | str) -> Column:
    """202403 for March 2024."""
    return (F.year(column(c)) * 100 + F.month(column(c))).cast(INT)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds as a double, exact to the microsecond."""
    micros = lambda c: F.unix_micros(column(c).cast("timestamp"))
    return (micros(end) - micros(start)).cast("double") / F.lit(1000000.0)
