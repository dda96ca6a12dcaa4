"""What every column cleaner gives: the new value, whether it changed, why it is rejected.

All three are plain Columns, so any number of cleaners share one projection, the counts of
any number of columns come from one aggregation, and the same cleaner runs on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from sparkscrub.functions.columns import ROW_INDEX, col, data_columns, dtype, require_index

REJECTS_SHOWN = 50


@dataclass(frozen=True)
class Cleaned:
    value: Column
    changed: Column
    """True where the cell counts as changed; null counts as false."""
    rejected: Column | None = None
    """True where the value is not accepted; null counts as false."""
    reason: Column | None = None
    """Why, for a rejected cell. It says nothing about the others."""
    shown: Column | None = None
    """The cleaned text a reject report shows, if it is not the value itself."""


Cleaner = Callable[[Column, DataType], Cleaned]


def differs(old: Column, new: Column) -> Column:
    return ~old.eqNullSafe(new)


def bind(df: DataFrame, cleaners: Mapping[str, Cleaner]) -> dict[str, Cleaned]:
    names = data_columns(df, cleaners)
    return {name: cleaners[name](col(name), dtype(df, name)) for name in names}


def clean(df: DataFrame, cleaners: Mapping[str, Cleaner]) -> DataFrame:
    """Replace each named column by its cleaned form, all in one projection."""
    return df.withColumns({name: c.value for name, c in bind(df, cleaners).items()})


def count_changes(df: DataFrame, cleaners: Mapping[str, Cleaner]) -> DataFrame:
    """One row per column: rows, cells changed, cells rejected. One pass, no row shuffled."""
    bound = bind(df, cleaners)
    sums = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(bound.values()):
        sums.append(F.count_if(c.changed).alias(f"changed_{i}"))
        rejected = F.lit(0).cast("bigint") if c.rejected is None else F.count_if(c.rejected)
        sums.append(rejected.alias(f"rejected_{i}"))
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.col("rows"),
            F.col(f"changed_{i}").alias("cells_changed"),
            F.col(f"rejected_{i}").alias("cells_rejected"),
        )
        for i, name in enumerate(bound)
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def rejects(df: DataFrame, column: str, cleaner: Cleaner, index: str = ROW_INDEX) -> DataFrame:
    """Every rejected cell of a column, with its row index. Nothing is capped."""
    require_index(df, index)
    c = bind(df, {column: cleaner})[column]
    shown = c.value if c.shown is None else c.shown
    # Filter first: the reason is then only worked out for what is rejected.
    return df.filter(F.lit(False) if c.rejected is None else c.rejected).select(
        col(index).alias("row_index"),
        col(column).cast("string").alias("original"),
        shown.cast("string").alias("cleaned"),
        (F.lit(None).cast("string") if c.reason is None else c.reason).alias("reason"),
    )


def first_rejects(
    df: DataFrame, column: str, cleaner: Cleaner, index: str = ROW_INDEX, n: int = REJECTS_SHOWN
) -> DataFrame:
    """The report view: the first ``n`` rejects in row order."""
    return rejects(df, column, cleaner, index).orderBy("row_index").limit(n)
