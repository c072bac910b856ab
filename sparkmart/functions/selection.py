from __future__ import annotations

from pyspark.sql import DataFrame


def all_but(df: DataFrame, *names: str) -> DataFrame:
    """All columns but these, of which each must be there."""
    if not names:
        raise ValueError("no columns to leave out")
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.drop(*names)
