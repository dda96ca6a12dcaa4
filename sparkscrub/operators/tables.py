"""Table sets: unions, schema match, selection by name, overview."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions.columns import ROW_INDEX
from sparkscrub.operators.running import dense_index

# Names that stand for all tables together.
COMBINED = "All Tables (Combined)"
DISJOINT = "All Tables (Union / Disjointed)"
_ALL = (COMBINED, DISJOINT, "all", "combined")

TableSet = Mapping[str, DataFrame]


def schemas_match(tables: Iterable[DataFrame]) -> bool:
    """Equal ordered column names; types do not matter. One table or none matches."""
    return len({tuple(c for c in t.columns if c != ROW_INDEX) for t in tables}) <= 1


def union_tables(tables: Iterable[DataFrame]) -> DataFrame:
    """All rows of all tables in order; columns a table lacks are null.

    A row index, where all tables have one, is issued anew as 0, 1, 2... in the order of the
    tables and their rows: the range of each table's index is measured (one job), the ranges
    are set one after the other, and the whole is numbered densely.
    """
    tables = list(tables)
    indexed = all(ROW_INDEX in t.columns for t in tables)
    if indexed:
        tables = _end_to_end(tables)
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return dense_index(union) if indexed else union


def _end_to_end(tables: list[DataFrame]) -> list[DataFrame]:
    """The tables with their row indexes moved so that each begins where the one before ends."""
    place = F.col(ROW_INDEX).cast("bigint")
    spans = reduce(DataFrame.unionByName, [
        t.agg(F.lit(i).alias("i"), F.min(place).alias("low"), F.max(place).alias("high")) for i, t in enumerate(tables)
    ]).collect()
    moved, begin = list(tables), 0
    for r in sorted(spans, key=lambda r: r["i"]):
        if r["low"] is None:
            continue
        moved[r["i"]] = tables[r["i"]].withColumn(ROW_INDEX, place - F.lit(r["low"]) + F.lit(begin).cast("bigint"))
        begin += r["high"] - r["low"] + 1
    if begin >= 1 << 63:
        raise ValueError("the row indexes of the tables are too wide to be set one after the other: number them densely first")
    return moved


def select_table(tables: TableSet, selection: str | None = None) -> tuple[str, DataFrame]:
    """(name, table) for a selection.

    Without one: everything combined if all columns are equal, else the first table. A
    selection names all tables, a table, or a part of a table's name; an unknown one gives
    the first table.
    """
    if not tables:
        raise ValueError("the table set is empty")
    first = next(iter(tables))
    if not selection:
        selection = COMBINED if len(tables) > 1 and schemas_match(tables.values()) else first
    if selection in _ALL:
        return selection, union_tables(tables.values())
    wanted = selection.lower()
    name = next((n for n in tables if wanted in n.lower()), first)
    return name, tables[name]


def tables_overview(tables: TableSet, actions: Mapping[str, int] | None = None, active: str | None = None) -> DataFrame:
    """One row per table: rows, columns, active and cleaned flags, number of actions taken."""
    actions = actions or {}

    def line(name: str, df: DataFrame) -> DataFrame:
        done = actions.get(name, 0)
        return df.agg(
            F.lit(name).alias("name"),
            F.count(F.lit(1)).alias("rows"),
            F.lit(len([c for c in df.columns if c != ROW_INDEX])).alias("columns"),
            F.lit(name == active).alias("is_active"),
            F.lit(done > 0).alias("is_cleaned"),
            F.lit(done).alias("actions_count"),
        )

    return reduce(DataFrame.unionByName, [line(n, t) for n, t in tables.items()])
