"""Cell-level coercions: a bad value becomes null, never an error."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T

from vitrine import schemas

# All blanks that a strip removes, not only the space.
WHITESPACE = " \t\n\r\f\v"

_STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
_DAY = r"^\d{4}-\d{2}-\d{2}$"


def null_if_token(col: Column, tokens: Iterable[str] = schemas.NA_TOKENS) -> Column:
    return F.when(~col.isin(*tokens), col)


def to_timestamp_or_null(col: Column, name: str) -> Column:
    """One declared format per column: a day for ``*_date``, a full stamp otherwise.

    The value never passes through a zoned timestamp, so a session zone with
    clock changes cannot move it.
    """
    pattern = _DAY if name.endswith("_date") else _STAMP
    return F.when(col.rlike(pattern), col.try_cast(T.TimestampNTZType()))


def to_number_or_null(col: Column, name: str) -> Column:
    return decimal_fit(col, schemas.numeric_type(name))


def decimal_fit(col: Column, decimal: T.DecimalType) -> Column:
    """Round half up to the column scale; null when it does not fit."""
    return col.try_cast(decimal)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))
