"""Type conversion with a full reject report."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions import dates, numbers, text
from sparkscrub.functions.columns import ROW_INDEX, col, is_float, is_numeric, is_text, require_index
from sparkscrub.operators.cleaned import Cleaned, Cleaner

# Reject reasons and target types.
NOT_NUMERIC = "Non-numeric characters present"
NOT_A_DATE = "Invalid or unparseable date format"
NOT_BOOLEAN = "Cannot be evaluated as true/false"

TARGETS = ("Integer", "Float", "Date", "Datetime", "Boolean", "String")


def _number(c: Column, dt: T.DataType, whole: bool, clean_currency: bool) -> Column:
    if is_numeric(dt):
        value = F.when(~F.isnan(c), c) if is_float(dt) else c
        return F.bround(value, 0).try_cast("bigint") if whole else value.cast("double")
    s = c.cast("string")
    if clean_currency:
        s = numbers.drop_currency(s)
    return numbers.parse_long(s) if whole else numbers.parse_double(s)


def type_converter(
    target_type: str,
    clean_currency_symbols: bool = True,
    fill_unconvertible: Any | None = None,
    case_transform: str | None = None,
    trim_whitespace: bool = True,
    collapse_spaces: bool = False,
    day_first: bool = True,
) -> Cleaner:
    """Convert to Integer, Float, Date, Datetime, Boolean or String.

    ``changed`` marks the converted cells. Cells that cannot be converted become null and
    are rejected. ``fill_unconvertible`` (numeric targets) also fills cells that were null
    before. The target is read in any case; an unknown one leaves the column alone.
    """
    target = target_type.strip().capitalize()

    def cleaner(c: Column, dt: T.DataType) -> Cleaned:
        present = ~F.isnan(c) & c.isNotNull() if is_float(dt) else c.isNotNull()
        if target in ("Integer", "Float"):
            new = _number(c, dt, target == "Integer", clean_currency_symbols)
            why = NOT_NUMERIC
        elif target in ("Date", "Datetime"):
            if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                new = c
            elif is_text(dt):
                new = dates.parse_free_date(c, day_first)
            else:
                new = F.lit(None).cast("timestamp_ntz")
            if target == "Date":
                new = dates.write_date(new)
            why = NOT_A_DATE
        elif target == "Boolean":
            new = c if isinstance(dt, T.BooleanType) else text.strip(c.cast("string")).try_cast("boolean")
            why = NOT_BOOLEAN
        elif target == "String":
            new = c.cast("string")
            if trim_whitespace:
                new = text.strip(new)
            if collapse_spaces:
                new = text.collapse_spaces(new)
            return Cleaned(text.apply_case(new, case_transform), present)
        else:
            return Cleaned(c, F.lit(False))

        value = new
        if fill_unconvertible is not None and target in ("Integer", "Float"):
            value = F.coalesce(new, F.lit(fill_unconvertible).cast("bigint" if target == "Integer" else "double"))
        return Cleaned(value, present & new.isNotNull(), present & new.isNull(), F.lit(why), shown=c.cast("string"))

    return cleaner


def preview_strings(
    df: DataFrame,
    column: str,
    case_transform: str | None = None,
    trim_whitespace: bool = True,
    collapse_spaces: bool = False,
    limit: int = 10,
    index: str = ROW_INDEX,
) -> DataFrame:
    """Before and after of the first ``limit`` non-null cells (the feature is the limit)."""
    require_index(df, index)
    first = (
        df.filter(col(column).isNotNull())
        .select(col(index).alias("row_index"), col(column).cast("string").alias("original_value"))
        .orderBy("row_index")
        .limit(limit)
    )
    convert = type_converter(
        "String", case_transform=case_transform, trim_whitespace=trim_whitespace, collapse_spaces=collapse_spaces
    )
    new = convert(F.col("original_value"), T.StringType()).value
    return first.select(
        "row_index", "original_value", new.alias("transformed_value"),
        (F.col("original_value") != new).alias("changed"),
    )
