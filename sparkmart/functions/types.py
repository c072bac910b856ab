"""The logical types."""

from __future__ import annotations

from pyspark.sql import types as T

INT = T.LongType()
STRING = T.StringType()
FLOAT = T.DoubleType()
#: UTC wall clock without a zone, microseconds.
TIMESTAMP = T.TimestampNTZType()
MONEY = T.DecimalType(38, 9)
BIGINT_ARRAY = T.ArrayType(T.LongType())
#: A point as well-known text.
GEOGRAPHY = T.StringType()


def decimal_type(precision: int, scale: int) -> T.DecimalType:
    """An exact decimal; what doesn't fit 38 digits is refused, never made a double."""
    for name, value in (("precision", precision), ("scale", scale)):
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(f"{name} must be an integer, not {value!r}")
    if precision < 1 or not 0 <= scale <= precision:
        raise ValueError(f"decimal({precision},{scale}): precision must be 1 or more, scale between 0 and precision")
    if precision > 38:
        raise ValueError(f"decimal({precision},{scale}) has more than 38 digits")
    return T.DecimalType(precision, scale)
