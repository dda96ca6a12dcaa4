"""Numeric text and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters taken off an amount before it is read.
CURRENCY = "[₹$,€£ ]"
# Spark's own cast also takes "1.5f" and "1d", hence the guard.
_NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?))\s*$"
_WHOLE = r"^\s*[+-]?\d+\s*$"


def drop_currency(c: Column) -> Column:
    return F.regexp_replace(c, CURRENCY, "")


def parse_double(c: Column) -> Column:
    """Text as DOUBLE, null where it is not a plain number."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def parse_long(c: Column) -> Column:
    """Text as BIGINT, rounding half to even; infinities and overflow give null."""
    rounded = F.bround(parse_double(c), 0).try_cast("bigint")
    return F.when(c.rlike(_WHOLE), F.trim(c).try_cast("bigint")).otherwise(rounded)


def round_half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def finite_or_null(c: Column) -> Column:
    """NaN and the infinities as null, for JSON."""
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~bad, c)
