from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .casting import column


def struct_of(*fields: tuple) -> Column:
    """A struct of (name, value) or (name, value, type); names must be different."""
    if not fields:
        raise ValueError("a struct needs a field")
    out, seen = [], set()
    for f in fields:
        if len(f) not in (2, 3) or not isinstance(f[0], str) or not f[0].isidentifier():
            raise ValueError(f"a field is (name, value) or (name, value, type), not {f!r}")
        if f[0] in seen:
            raise ValueError(f"two fields are called {f[0]}")
        seen.add(f[0])
        value = f[1] if isinstance(f[1], Column) else F.lit(f[1])
        kind: DataType | str | None = f[2] if len(f) == 3 else None
        out.append((value.cast(kind) if kind is not None else value).alias(f[0]))
    return F.struct(*out)


def json_value(c: Column | str) -> Column:
    """JSON text; null fields are kept."""
    return F.to_json(column(c), {"ignoreNullFields": "false"})
