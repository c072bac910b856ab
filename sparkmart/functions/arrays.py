from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import BIGINT_ARRAY, INT

STEP = re.compile(r"([1-9]\d*) (day|week|month|quarter|year)s?")


def _column(c: Column | int | str) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def int_series(start: Column | int | str, stop: Column | int | str, step: int = 1) -> Column:
    """start, start + step, ... up to stop; empty if start is beyond it."""
    if isinstance(step, bool) or not isinstance(step, int) or step == 0:
        raise ValueError(f"a step must be a whole number other than 0, not {step!r}")
    a, b = _column(start).cast(INT), _column(stop).cast(INT)
    runs = a <= b if step > 0 else a >= b
    return F.when(runs, F.sequence(a, b, F.lit(step).cast(INT))).when(~runs, F.array().cast(BIGINT_ARRAY))


def date_series(start: Column | str, stop: Column | str, step: str = "1 day") -> Column:
    """Dates from start to stop, both in it; each is start plus so many steps, so that months' ends don't drift."""
    got = STEP.fullmatch(step)
    if not got:
        raise ValueError(f"no such step: {step!r}; it is a number and day, week, month, quarter or year")
    n, part = int(got[1]), got[2]
    by = F.make_interval(months=F.lit(3 * n)) if part == "quarter" else F.make_interval(**{f"{part}s": F.lit(n)})
    a, b = (F.to_date(_column(x)) for x in (start, stop))
    return F.when(a <= b, F.sequence(a, b, by)).when(a > b, F.array().cast("array<date>"))


def unnest(values: Column | str, name: str) -> Column:
    """A row for each element; none for an empty or null array."""
    if not name.isidentifier():
        raise ValueError(f"not a column name: {name!r}")
    return F.explode(_column(values)).alias(name)
