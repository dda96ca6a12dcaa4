"""Null, blank, distinct and duplicate counts of every column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions import text
from sparkscrub.functions.columns import ROW_INDEX, col, data_columns, dtype, group_key, is_missing, is_text

_COUNTS = ("total_values", "na_count", "empty_string_count", "unique_values")


def _value_counts_per_column(df: DataFrame, names: list[str]) -> DataFrame:
    """Counts by column position, each column grouped by itself.

    Every branch reads one column of the source and keeps its type, and the groups are
    counted map-side first, so a value that fills a third of the column is one row per task.
    """

    def branch(i: int, name: str) -> DataFrame:
        dt = dtype(df, name)
        value = F.col("v")
        rows = F.coalesce(F.sum("n"), F.lit(0))
        blank = F.sum(F.when(text.is_blank(value), F.col("n"))) if is_text(dt) else F.lit(0)
        groups = df.select(group_key(col(name), dt).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        return groups.agg(
            F.lit(i).alias("position"),
            rows.cast("bigint").alias("total_values"),
            F.coalesce(F.sum(F.when(value.isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("na_count"),
            F.coalesce(blank, F.lit(0)).cast("bigint").alias("empty_string_count"),
            F.count(value).alias("unique_values"),
        )

    return reduce(DataFrame.unionByName, [branch(i, n) for i, n in enumerate(names)])


def _value_counts_one_scan(df: DataFrame, names: list[str]) -> DataFrame:
    """The same counts from one scan: cells as (position, text) pairs, grouped together.

    Texts of two values differ where the values do: floats are written in full, times as microseconds."""
    def cell(n: str) -> Column:
        dt = dtype(df, n)
        key = group_key(col(n), dt)
        if isinstance(dt, T.TimestampType):
            key = F.unix_micros(key)
        return F.hex(key) if isinstance(dt, T.BinaryType) else key.cast("string")

    cells = [F.struct(F.lit(i).alias("position"), cell(n).alias("v")) for i, n in enumerate(names)]
    textual = [i for i, n in enumerate(names) if is_text(dtype(df, n))]
    groups = df.select(F.inline(F.array(*cells))).groupBy("position", "v").agg(F.count(F.lit(1)).alias("n"))
    blank = F.col("position").isin(textual) & text.is_blank(F.col("v")) if textual else F.lit(False)
    return groups.groupBy("position").agg(
        F.sum("n").alias("total_values"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("na_count"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("empty_string_count"),
        F.count("v").alias("unique_values"),
    )


def _sketched_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """One aggregation without a shuffle of values; distinct counts are estimates."""
    sums: list[Column] = [F.count(F.lit(1)).alias("total_values")]
    for i, n in enumerate(names):
        c, dt = col(n), dtype(df, n)
        blank = F.count_if(text.is_blank(c)) if is_text(dt) else F.lit(0).cast("bigint")
        sums += [
            F.count_if(is_missing(c, dt)).alias(f"na_{i}"),
            blank.alias(f"blank_{i}"),
            F.approx_count_distinct(group_key(c, dt)).alias(f"unique_{i}"),
        ]
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.col("total_values"), F.col(f"na_{i}").alias("na_count"),
            F.col(f"blank_{i}").alias("empty_string_count"), F.col(f"unique_{i}").alias("unique_values"),
        )
        for i in range(len(names))
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def analyze_nulls(
    df: DataFrame, approx_distinct: bool = False, one_scan: bool | None = None, index: str = ROW_INDEX
) -> DataFrame:
    """One row per column: missing, blank, distinct and repeated values, percentage, status.

    Exact by default, with one result by either plan: columns are grouped one by one, each read
    once, or all cells in a single pass. Left open, ``one_scan`` is taken where a file would be
    parsed once per column; ask for it where the input is costly to compute again.
    ``approx_distinct`` estimates distinct values and shuffles nothing. A blank counts as missing
    and still as a distinct value.
    """
    if one_scan is None:
        one_scan = not all(f.lower().endswith((".parquet", ".orc")) for f in df.inputFiles())
    names = [n for n in data_columns(df) if n != index]
    count = _sketched_counts if approx_distinct else _value_counts_one_scan if one_scan else _value_counts_per_column
    counted = count(df, names)
    if not approx_distinct and one_scan:
        frame = df.sparkSession.createDataFrame([(i,) for i in range(len(names))], "position int")
        counted = frame.join(counted, "position", "left").na.fill(0, list(_COUNTS))
    by_position = F.col("position")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), by_position + 1)
    kind = F.element_at(F.array(*[F.lit(dtype(df, n).simpleString()) for n in names]), by_position + 1)
    nulls = F.col("na_count") + F.col("empty_string_count")
    rows = F.col("total_values")
    with_nulls = F.col("null_count") > 0
    return (
        counted.withColumn("null_count", nulls)
        .select(
            "position",
            label.alias("column"),
            kind.alias("data_type"),
            "total_values",
            "null_count",
            "na_count",
            "empty_string_count",
            percent(F.col("null_count"), rows).alias("null_percentage"),
            "unique_values",
            F.greatest(F.lit(0).cast("bigint"), rows - F.col("null_count") - F.col("unique_values")).alias(
                "duplicate_values"
            ),
            F.when(with_nulls, "⚠").otherwise("✓").alias("status"),
            F.when(with_nulls, "Fix").otherwise("—").alias("action"),
        )
    )


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, two digits, 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part / F.nullif(whole, F.lit(0)) * 100, 2))


def dataset_nulls(columns: DataFrame) -> DataFrame:
    """Dataset rollup of ``analyze_nulls``: one row."""
    return columns.agg(
        F.coalesce(F.max("total_values"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.coalesce(F.sum("total_values"), F.lit(0)).alias("total_cells"),
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("total_nulls"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"),
        F.coalesce(F.sum("empty_string_count"), F.lit(0)).alias("total_empty_strings"),
    ).withColumn("overall_null_percentage", percent(F.col("total_nulls"), F.col("total_cells")))


def columns_by_missing(columns: DataFrame) -> DataFrame:
    """Columns with missing cells first, most missing on top, then the complete ones."""
    return columns.select("column", "data_type", "null_count", "null_percentage", "position").orderBy(
        F.desc("null_count"), F.asc("position")
    )


def missing_counts(df: DataFrame, index: str = ROW_INDEX) -> DataFrame:
    """Only the missing count of each column: (column, null_count), one pass."""
    names = [n for n in data_columns(df) if n != index]
    sums = [F.count_if(is_missing(col(n), dtype(df, n))).alias(f"n{i}") for i, n in enumerate(names)]
    rows = [F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("null_count")) for i, n in enumerate(names)]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


