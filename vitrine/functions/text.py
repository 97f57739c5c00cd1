"""Brazilian display formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EMPTY = "—"


def _blank(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def fmt_brl(col: Column) -> Column:
    """``R$ 1.234,56``; a dash for null."""
    value = col.cast("double")
    text = F.concat(F.lit("R$ "), F.translate(F.format_number(value, 2), ",.", ".,"))
    return F.when(_blank(value), F.lit(EMPTY)).otherwise(text)


def fmt_int(col: Column) -> Column:
    """Whole number with ``.`` between the thousands."""
    return F.translate(F.format_number(col, 0), ",", ".")


def fmt_date(col: Column) -> Column:
    """``dd/MM/yyyy``; a dash for null."""
    return F.coalesce(F.date_format(col, "dd/MM/yyyy"), F.lit(EMPTY))


def fmt_one_decimal(col: Column) -> Column:
    """One decimal place, no grouping."""
    return F.translate(F.format_number(col.cast("double"), 1), ",", "")


def fmt_pct1(col: Column) -> Column:
    """One decimal place and a percent sign."""
    return F.concat(fmt_one_decimal(col), F.lit("%"))
