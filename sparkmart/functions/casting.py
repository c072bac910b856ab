from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .types import STRING, TIMESTAMP


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_cast(c: Column | str, to: DataType | str) -> Column:
    """Null where the value can't be cast."""
    return column(c).try_cast(to)


def to_text(c: Column | str) -> Column:
    return column(c).cast(STRING)


def to_utc(c: Column | str) -> Column:
    """An instant as UTC wall clock (the session's zone must be UTC); a wall clock stays as it is."""
    return column(c).cast(TIMESTAMP)
