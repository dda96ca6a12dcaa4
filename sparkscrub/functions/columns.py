"""Schema questions and the notion of a missing value."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_INDEX = "_row_index"

_FLOATS = (T.FloatType, T.DoubleType)
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def col(name: str) -> Column:
    """Column by exact name, also where the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_float(dt: T.DataType) -> bool:
    return isinstance(dt, _FLOATS)


def is_integer(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGERS)


def is_numeric(dt: T.DataType) -> bool:
    return is_float(dt) or is_integer(dt) or isinstance(dt, T.DecimalType)


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, _NESTED)


def data_columns(df: DataFrame, wanted: Iterable[str] | None = None) -> list[str]:
    """The user's columns, in order: without the row index, checked to exist."""
    if wanted is None:
        return [c for c in df.columns if c != ROW_INDEX]
    names = list(wanted)
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")
    return names


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_text(dtype(df, c))]


def is_missing(c: Column, dt: T.DataType) -> Column:
    """NULL, and NaN for floating point columns."""
    return c.isNull() | F.isnan(c) if is_float(dt) else c.isNull()


def nan_to_null(c: Column, dt: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if is_float(dt) else c


def group_key(c: Column, dt: T.DataType) -> Column:
    """A form of ``c`` that can be grouped: NaN counts as null, -0.0 as 0.0, nested values as JSON text."""
    if isinstance(dt, T.VariantType) or is_nested(dt):
        return F.to_json(c)
    if is_float(dt):
        return F.when(c == 0, F.lit(0.0).cast(dt)).when(~F.isnan(c), c)
    return c


def require_index(df: DataFrame, index: str) -> str:
    if index not in df.columns:
        raise ValueError(
            f"column {index!r} gives the row order and is absent: "
            "read with row_index=True or name a unique integer column"
        )
    if not is_integer(dtype(df, index)):
        raise ValueError(f"column {index!r} must be an integer column")
    return index
