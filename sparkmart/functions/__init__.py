"""Column functions with one exact meaning each; arguments are checked when the column is made."""

from .arrays import date_series, int_series, unnest
from .casting import safe_cast, to_text, to_utc
from .dates import day_of_week_iso, days_between, format_date, format_month, month_number, month_start, seconds_between, trunc_to
from .layout import Layout, physical_layout
from .money import minus, money, quotient, round_money, safe_divide
from .nested import json_value, struct_of
from .selection import all_but
from .text import matches, surrogate_key
from .types import BIGINT_ARRAY, FLOAT, GEOGRAPHY, INT, MONEY, STRING, TIMESTAMP, decimal_type

__all__ = [
    "BIGINT_ARRAY", "FLOAT", "GEOGRAPHY", "INT", "MONEY", "STRING", "TIMESTAMP", "Layout", "all_but", "date_series", "day_of_week_iso",
    "days_between", "decimal_type", "format_date", "format_month", "int_series", "json_value", "matches", "minus", "money", "month_number",
    "month_start", "physical_layout", "quotient", "round_money", "safe_cast", "safe_divide", "seconds_between", "struct_of", "surrogate_key",
    "to_text", "to_utc", "trunc_to", "unnest",
]
