"""Column functions: text, numbers, dates."""

from tablescope.functions.dates import jalali_to_date, parse_dates, parse_jalali
from tablescope.functions.numbers import (
    money_text, number_text, numeric_parse_ratio, parse_number, percent_text, to_double,
)
from tablescope.functions.text import (
    empty_to_null, normalize_column_name, normalize_text, slugify_column_name, to_ascii_digits,
)

__all__ = [
    "empty_to_null", "jalali_to_date", "money_text", "normalize_column_name",
    "normalize_text", "number_text", "numeric_parse_ratio", "parse_dates", "parse_jalali",
    "parse_number", "percent_text", "slugify_column_name", "to_ascii_digits", "to_double",
]
