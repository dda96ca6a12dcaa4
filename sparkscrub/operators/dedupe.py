"""Duplicate rows: remove them, count them, list them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions.columns import ROW_INDEX, col, data_columns, dtype, group_key, is_float, require_index

HOT_GROUPS = 1000
DUPLICATES_SHOWN = 50


def _key_names(df: DataFrame, subset: Iterable[str] | None, index: str) -> list[str]:
    """The subset's known columns; all data columns without a subset."""
    everything = [c for c in data_columns(df) if c != index]
    known = [c for c in subset if c in everything] if subset else []
    return known or everything


def remove_duplicates(
    df: DataFrame, subset: Iterable[str] | None = None, keep: str = "first", index: str = ROW_INDEX
) -> DataFrame:
    """Keep the first or last row (by ``index``) of each group of equal rows.

    Any other ``keep`` means first; unknown subset columns are ignored. Every map task sends
    on at most one row per group, so a group of any size costs no more than the others.
    """
    require_index(df, index)
    keys = _key_names(df, subset, index)
    last = keep == "last"
    whole_row = len(keys) == len([c for c in df.columns if c != index])
    if whole_row and not any(_has_map(dtype(df, k)) for k in keys):
        edge = F.max(col(index)) if last else F.min(col(index))
        # Zeros, NaN and null meet in one group; the cells are those of the row that is kept.
        floats = [k for k in keys if is_float(dtype(df, k))]
        cells = {k: (F.max_by if last else F.min_by)(col(k), col(index)) for k in floats}
        grouped = df.groupBy(*[(group_key(col(k), dtype(df, k)) if k in cells else col(k)).alias(f"_key_{k}" if k in cells else k) for k in keys])
        kept = grouped.agg(edge.alias(index), *[c.alias(k) for k, c in cells.items()])
        return kept.select([col(c) for c in df.columns])
    order = col(index).desc() if last else col(index).asc()
    group = Window.partitionBy(*[group_key(col(k), dtype(df, k)) for k in keys]).orderBy(order)
    return df.withColumn("_nth", F.row_number().over(group)).filter("_nth = 1").drop("_nth")


def _has_map(dt: T.DataType) -> bool:
    return isinstance(dt, T.VariantType) or "map<" in dt.simpleString()


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with one groupable column per key. Plain keys are used as they are."""
    named = {f"_key_{i}": group_key(col(k), dtype(df, k)) for i, k in enumerate(keys)}
    return df.withColumns(named), list(named)


def duplicate_groups(df: DataFrame, subset: Iterable[str] | None = None, index: str = ROW_INDEX) -> DataFrame:
    """Group sizes, one row per distinct key: (keys..., rows)."""
    keys = _key_names(df, subset, index)
    plain = df.select([group_key(col(k), dtype(df, k)).alias(k) for k in keys])
    return plain.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_summary(df: DataFrame, subset: Iterable[str] | None = None, index: str = ROW_INDEX) -> DataFrame:
    """One row: total_rows, duplicate_rows (after the first of each group), percentage, flag."""
    total = F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint")
    repeated = (total - F.count(F.lit(1))).cast("bigint")
    counted = duplicate_groups(df, subset, index).agg(total.alias("total_rows"), repeated.alias("duplicate_rows"))
    share = F.when(F.col("total_rows") == 0, F.lit(0.0)).otherwise(
        F.bround(F.col("duplicate_rows") / F.nullif("total_rows", F.lit(0)) * 100, 2)
    )
    return counted.withColumns(
        {"duplicate_percentage": share, "has_duplicates": F.col("duplicate_rows") > 0}
    )


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def duplicate_rows(df: DataFrame, subset: Iterable[str] | None = None, index: str = ROW_INDEX) -> DataFrame:
    """Every member of every group of more than one row, whole and in no order.

    The members of the largest groups are found by a broadcast of those groups' keys, which
    are at most HOT_GROUPS rows. What is left for the shuffled join has no group larger than
    a HOT_GROUPS-th of the table.
    """
    keyed, keys = _keyed(df, _key_names(df, subset, index))
    groups = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    hot = groups.orderBy(F.desc("_size"), *keys).limit(HOT_GROUPS)
    left, right = keyed.alias("l"), F.broadcast(hot).alias("r")
    of_hot = left.join(right, _same(keys), "left_semi")
    rest = left.join(right, _same(keys), "left_anti")
    of_rest = rest.alias("l").join(groups.alias("r"), _same(keys), "left_semi")
    return of_hot.unionByName(of_rest).drop(*keys)


def first_duplicate_rows(
    df: DataFrame, subset: Iterable[str] | None = None, index: str = ROW_INDEX, n: int = DUPLICATES_SHOWN
) -> DataFrame:
    """The first ``n`` members of duplicate groups, in row order (a report view).

    A row among the first ``n`` belongs to one of the ``n`` groups that start first, so only
    those groups' keys (at most ``n`` rows) are broadcast and no group is gathered.
    """
    require_index(df, index)
    keyed, keys = _keyed(df, _key_names(df, subset, index))
    groups = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.min(col(index)).alias("_start"))
    early = groups.filter("_size > 1").orderBy("_start").limit(n)
    members = keyed.alias("l").join(F.broadcast(early).alias("r"), _same(keys), "left_semi")
    return members.drop(*keys).orderBy(col(index)).limit(n)
