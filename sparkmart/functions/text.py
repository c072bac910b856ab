from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casting import column, to_text


def surrogate_key(*parts: Column | str) -> Column:
    """MD5 of the parts as text, joined by two bars; null parts are left out."""
    if not parts:
        raise ValueError("a key needs a part")
    return F.md5(F.concat_ws("||", *(to_text(p) for p in parts)))


def matches(c: Column | str, pattern: str) -> Column:
    """Whether the pattern is found anywhere. Look-around and back-references aren't portable, and are refused."""
    for sign in ("(?=", "(?!", "(?<=", "(?<!", "\\1"):
        if sign in pattern:
            raise ValueError(f"not portable: {sign} in {pattern!r}")
    return column(c).rlike(pattern)
