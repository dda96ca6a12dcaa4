"""Search, sort and page."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions.columns import (
    ROW_INDEX, col, data_columns, dtype, is_missing, is_numeric, is_text, nan_to_null, require_index,
)
from sparkscrub.functions.text import iso_text
from sparkscrub.operators.order_stats import nth_text, nth_value

PAGE_SIZE = 50
DEEP = 100_000
"""From this row on, a page is found by its first key instead of by skipping rows."""


def matches(df: DataFrame, query: str, regex: bool = False, index: str = ROW_INDEX) -> Column:
    """True where any data column, as lower-case text, holds the query (or matches it as a regex)."""
    query = query.lower()

    def hit(name: str) -> Column:
        shown = F.lower(col(name).cast("string"))
        return F.coalesce(shown.rlike(query) if regex else shown.contains(query), F.lit(False))

    return reduce(lambda a, b: a | b, [hit(n) for n in data_columns(df) if n != index])


def search_rows(df: DataFrame, query: str, regex: bool = False, index: str = ROW_INDEX) -> DataFrame:
    return df.filter(matches(df, query, regex, index)) if query else df


def _order(df: DataFrame, sort_col: str | None, ascending: bool, index: str) -> list[Column]:
    if sort_col is None or sort_col not in df.columns:
        return [col(index)]
    key = nan_to_null(col(sort_col), dtype(df, sort_col))
    return [key.asc_nulls_last() if ascending else key.desc_nulls_last(), col(index)]


def sort_rows(df: DataFrame, sort_col: str | None, ascending: bool = True, index: str = ROW_INDEX) -> DataFrame:
    """Sorted by one column, missing values last in both directions, ties in row order."""
    return df.orderBy(*_order(df, sort_col, ascending, require_index(df, index)))


def page_rows(df: DataFrame, index: str = ROW_INDEX) -> DataFrame:
    """Rows as a report shows them: NaN as null, dates as ISO text."""

    def shown(name: str) -> Column:
        dt = dtype(df, name)
        if isinstance(dt, T.DateType):
            return F.date_format(col(name), "yyyy-MM-dd")
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            return iso_text(col(name))
        return nan_to_null(col(name), dt)

    return df.select([shown(n).alias(n) for n in df.columns])


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total_rows: int
    dataset_total_rows: int
    total_pages: int
    current_page: int
    page_size: int
    column_types: dict[str, str]


def preview(
    df: DataFrame,
    page: int = 1,
    page_size: int = PAGE_SIZE,
    search_query: str = "",
    sort_col: str | None = None,
    sort_dir: str = "asc",
    regex: bool = False,
    index: str = ROW_INDEX,
    deep: int = DEEP,
) -> Page:
    """One page of the filtered, sorted table. The page is clamped to the pages there are.

    The rows come from a top-k. For pages in the second half the order is turned round, so
    the top-k runs from the nearer end; ``deep`` rows or more from both ends the sort key of the
    page's first row is found first, and the top-k starts there, so it is never longer than that.
    """
    require_index(df, index)
    hit = matches(df, search_query, regex, index) if search_query else F.lit(True)
    total, found = df.agg(F.count(F.lit(1)), F.count_if(hit)).first()
    pages = max(1, -(-found // page_size))
    page = max(1, min(page, pages))
    ascending = sort_dir.lower() == "asc"
    order = _order(df, sort_col, ascending, index)
    start = (page - 1) * page_size
    size = min(page_size, found - start)
    part = df.filter(hit)
    if deep < start < found - deep and _has_ranks(df, sort_col):
        rows = part.filter(_at_or_after(part, sort_col, ascending, index, start, deep)).orderBy(*order).limit(size)
    elif min(start, found - start) >= 1 << 31:
        raise ValueError(f"a page this deep needs a sort column of numbers, text or times, not {sort_col!r}")
    elif start <= found // 2:
        rows = part.orderBy(*order).offset(start).limit(page_size)
    else:
        tail = part.orderBy(*_reversed(df, sort_col, ascending, index)).offset(found - start - size)
        rows = tail.limit(size).orderBy(*order)
    types = {n: dtype(df, n).simpleString() for n in df.columns if n != index}
    return Page(page_rows(rows, index), found, total, pages, page, page_size, types)


def _has_ranks(df: DataFrame, sort_col: str | None) -> bool:
    """Whether the sort key can be searched by rank: numbers, text, dates and times can."""
    if sort_col is None or sort_col not in df.columns:
        return True
    dt = dtype(df, sort_col)
    return is_numeric(dt) or is_text(dt) or isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _at_or_after(part: DataFrame, sort_col: str | None, ascending: bool, index: str, start: int, small: int) -> Column:
    """The rows from sorted position ``start`` on, as a condition on sort key and index."""
    place = col(index)

    def place_at(rows: DataFrame, n: int, k: int) -> Column:
        return place >= nth_value(rows.select(place.alias("v")), n, k, small)

    if sort_col is None or sort_col not in part.columns:
        return place_at(part, part.count(), start)
    key = nan_to_null(col(sort_col), dtype(part, sort_col))
    rows, present = part.agg(F.count(F.lit(1)), F.count(key)).first()
    if start >= present:
        return key.isNull() & place_at(part.filter(key.isNull()), rows - present, start - present)
    nth = nth_text if is_text(dtype(part, sort_col)) else nth_value
    values = part.select(key.alias("v")).filter("v IS NOT NULL")
    first = F.lit(nth(values, present, start if ascending else present - 1 - start, small))
    beyond, ahead = (key > first, key < first) if ascending else (key < first, key > first)
    before, ties = part.agg(F.count_if(ahead), F.count_if(key == first)).first()
    return beyond | key.isNull() | ((key == first) & place_at(part.filter(key == first), ties, start - before))


def _reversed(df: DataFrame, sort_col: str | None, ascending: bool, index: str) -> list[Column]:
    if sort_col is None or sort_col not in df.columns:
        return [col(index).desc()]
    key = nan_to_null(col(sort_col), dtype(df, sort_col))
    return [key.desc_nulls_first() if ascending else key.asc_nulls_first(), col(index).desc()]


def cells(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Row, column and cell totals and the missing cells, in one pass."""
    names = data_columns(df, columns)
    missing = reduce(lambda a, b: a + b, [F.count_if(is_missing(col(n), dtype(df, n))) for n in names])
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        F.lit(len(names)).cast("bigint").alias("columns"),
        F.greatest(rows * len(names), F.lit(1)).cast("bigint").alias("cells"),
        missing.cast("bigint").alias("missing_cells"),
    )
