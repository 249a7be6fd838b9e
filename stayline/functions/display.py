"""Text forms for reports. Exports keep the numeric columns.

Numbers are rounded half to even before they are printed, so the text does not
depend on a formatter's own tie rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayline.functions.columns import round_even

MISSING = "N/A"


def _text(value: Column, pattern: str, digits: int) -> Column:
    return F.when(value.isNotNull(), F.format_string(pattern, round_even(value, digits)))


def percent_text(value: Column, digits: int = 1) -> Column:
    """`value` is already a percentage."""
    return F.coalesce(_text(value, f"%.{digits}f%%", digits), F.lit(MISSING))


def signed_percent_text(value: Column, digits: int = 1) -> Column:
    return F.coalesce(_text(value, f"%+.{digits}f%%", digits), F.lit(MISSING))


def money(value: Column, symbol: str = "₹") -> Column:
    whole = F.format_number(round_even(value).cast("long"), 0)
    return F.coalesce(F.concat(F.lit(symbol), whole), F.lit(MISSING))


def lakh(value: Column) -> Column:
    shown = _text(value / F.lit(100000.0), "%.1f", 1)
    return F.coalesce(F.concat(F.lit("₹"), shown, F.lit("L")), F.lit(MISSING))


def rupee_thousands(value: Column) -> Column:
    shown = _text(value / F.lit(1000.0), "%.0f", 0)
    return F.coalesce(F.concat(F.lit("₹"), shown, F.lit("K")), F.lit(MISSING))


def stars(value: Column, out_of: int | None = None) -> Column:
    filled = F.repeat(F.lit("★"), value.cast("int"))
    if out_of is None:
        return filled
    return F.concat(filled, F.repeat(F.lit("☆"), F.lit(out_of) - value.cast("int")))


def long_date(day: Column) -> Column:
    return F.date_format(day, "dd MMMM yyyy")
