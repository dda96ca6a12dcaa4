"""Null handling: drop rows or fill by constant, mean, median, mode or neighbour."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions import text
from sparkscrub.functions.columns import (
    ROW_INDEX, col, data_columns, dtype, is_float, is_integer, is_missing, is_numeric, is_text, nan_to_null,
)
from sparkscrub.operators.cleaned import Cleaned, Cleaner, clean
from sparkscrub.operators.order_stats import column_means, column_medians, column_mode, exact_means, exact_medians
from sparkscrub.operators.ordered_fill import ordered_fill

STRATEGIES = ("replace", "remove_rows", "mean", "median", "mode", "ffill", "bfill")


def blanks_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Blank text becomes null in the named (or all) text columns."""
    names = [n for n in data_columns(df, columns) if is_text(dtype(df, n))]
    return df.withColumns({n: text.blank_to_null(col(n)) for n in names})


def null_cells(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """Per row: how many of the named cells are missing."""
    flags = [is_missing(col(n), dtype(df, n)).cast("bigint") for n in data_columns(df, columns)]
    return reduce(lambda a, b: a + b, flags)


def with_gaps(df: DataFrame, names: list[str]) -> list[str]:
    """Those of the named columns that have missing cells: one pass, one row."""
    if not names:
        return []
    counts = df.agg(*[F.count_if(is_missing(col(n), dtype(df, n))).alias(f"n{i}") for i, n in enumerate(names)]).first()
    return [n for n, k in zip(names, counts) if k]


def drop_null_rows(df: DataFrame, column: str | None = None) -> DataFrame:
    """Drop rows where the column (or any column) is missing."""
    names = data_columns(df, None if column is None else [column])
    return df.na.drop(how="any", subset=names)


def fill_cleaner(value: Any) -> Cleaner:
    """Fill missing cells with a constant.

    A constant that the column's type cannot hold widens the column: a fraction turns whole
    numbers into DOUBLE (a Decimal one into DECIMAL), a whole number out of range into the next
    type that holds it, more digits a DECIMAL into a wider one, and text any other column into text.
    """

    def cleaner(c: Column, dt: T.DataType) -> Cleaned:
        gap = is_missing(c, dt)
        present = nan_to_null(c, dt)
        to, new_value = _holding(dt, value)
        new = F.coalesce(present.cast(to), F.lit(new_value).cast(to))
        return Cleaned(new, gap if value is not None else F.lit(False))

    return cleaner


_WHOLE = ((T.ByteType, 8), (T.ShortType, 16), (T.IntegerType, 32), (T.LongType, 64))


def _holding(dt: T.DataType, value: Any) -> tuple[T.DataType, Any]:
    """The type that holds both the column and the constant, and the constant for it."""
    if value is None:
        return dt, None
    if is_text(dt) or isinstance(value, str):
        return T.StringType(), str(value) if isinstance(value, Decimal) else value
    if isinstance(value, bool) or not is_numeric(dt) or is_float(dt):
        return dt, float(value) if is_float(dt) and isinstance(value, Decimal) else value
    if is_integer(dt) and isinstance(value, float):
        return T.DoubleType(), value
    exact = value if isinstance(value, Decimal) else Decimal(str(value))
    if is_integer(dt):
        bits = dict((k, b) for k, b in _WHOLE)[type(dt)]
        if exact == exact.to_integral_value():
            for kind, held in _WHOLE:
                if held >= bits and -(1 << held - 1) <= exact < 1 << held - 1:
                    return kind(), int(exact)
        dt = T.DecimalType(19 if bits == 64 else 10, 0)
    scale = max(dt.scale, -exact.as_tuple().exponent if exact != exact.to_integral_value() else 0)
    whole = max(dt.precision - dt.scale, len(str(abs(int(exact)))))
    return T.DecimalType(min(38, whole + scale), min(scale, max(0, 38 - whole))), exact


def statistic_fills(
    df: DataFrame, columns: Iterable[str], strategy: str, fallback: Any = "Unknown"
) -> dict[str, Cleaner]:
    """Fill cleaners whose constants are measured on ``df``; ``fallback`` where nothing is numeric.

    Means and medians are rounded to two digits, ties to even. Those of DECIMAL columns, and of BIGINT
    columns with values that DOUBLE cannot tell apart, are exact, and so is the filled column: DECIMAL.
    """
    names = data_columns(df, columns)
    if strategy == "mode":
        found = {n: column_mode(df, n) for n in names}
    else:
        exact = _exact_columns(df, names)
        rest = [n for n in names if n not in exact]
        measure, measure_exact = (column_means, exact_means) if strategy == "mean" else (column_medians, exact_medians)
        found = measure(df, rest) | measure_exact(df, exact)
        known = {n: v for n, v in found.items() if v is not None}
        if known:
            # Rounded by Spark, so that ties go to even as everywhere else.
            row = df.sparkSession.range(1).select([
                F.bround(F.lit(v).cast("decimal(38,6)") if n in exact else F.lit(float(v)), 2).alias(f"r{i}")
                for i, (n, v) in enumerate(known.items())
            ]).first()
            found |= {n: v.quantize(Decimal("0.01")) if n in exact else v for n, v in zip(known, row)}
    return {n: fill_cleaner(fallback if v is None else v) for n, v in found.items()}


def _exact_columns(df: DataFrame, names: list[str]) -> list[str]:
    """DECIMAL columns, and BIGINT ones with values beyond 2^53 (one pass)."""
    longs = [n for n in names if isinstance(dtype(df, n), T.LongType)]
    far = set()
    if longs:
        beyond = [F.coalesce(F.bool_or((col(n) > 1 << 53) | (col(n) < -(1 << 53))), F.lit(False)).alias(f"b{i}") for i, n in enumerate(longs)]
        far = {n for n, b in zip(longs, df.agg(*beyond).first()) if b}
    return [n for n in names if n in far or isinstance(dtype(df, n), T.DecimalType)]


def fill_nulls(
    df: DataFrame,
    column: str | None = None,
    strategy: str = "replace",
    fill_value: Any = "Unknown",
    treat_empty_as_null: bool = True,
    index: str = ROW_INDEX,
) -> DataFrame:
    """Handle missing cells of one column, or of all columns.

    ``mean``, ``median`` and ``mode`` measure the column first and then fill lazily.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    names = data_columns(df, None if column is None else [column])
    names = [n for n in names if n != index]
    if treat_empty_as_null:
        df = blanks_to_null(df, names)
    if strategy == "remove_rows":
        return drop_null_rows(df, column)
    if strategy in ("ffill", "bfill"):
        return ordered_fill(df, names, backward=strategy == "bfill", index=index)
    if strategy == "replace":
        return clean(df, {n: fill_cleaner(fill_value) for n in names})
    return clean(df, statistic_fills(df, names, strategy, fill_value))


def null_report(before: DataFrame, after: DataFrame, column: str | None = None, index: str = ROW_INDEX) -> DataFrame:
    """(nulls_handled, rows_removed) of a null-handling step; blanks in ``before`` count as null."""
    names = [n for n in data_columns(before, None if column is None else [column]) if n != index]

    def totals(df: DataFrame, side: int) -> DataFrame:
        return df.agg(
            F.lit(side).alias("side"), F.sum(null_cells(df, names)).alias("nulls"), F.count(F.lit(1)).alias("rows")
        )

    both = totals(blanks_to_null(before, names), 1).unionByName(totals(after, -1))
    return both.agg(
        F.coalesce(F.sum(F.col("nulls") * F.col("side")), F.lit(0)).cast("bigint").alias("nulls_handled"),
        F.sum(F.col("rows") * F.col("side")).cast("bigint").alias("rows_removed"),
    )
