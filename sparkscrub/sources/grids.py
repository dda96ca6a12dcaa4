"""Extracted cell grids to tables.

The input has one row per extracted table row: (doc_id, page, table, row_no, cells), where
``cells`` is an array of text and the row with the smallest ``row_no`` is the header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscrub.functions import text
from sparkscrub.functions.columns import ROW_INDEX
from sparkscrub.session import written_table

KEYS = ["doc_id", "page", "table"]
PREVIEW_ROWS = 5


def plain_header(cells: Column) -> Column:
    """Header cells trimmed, line breaks as spaces; empty ones are ``Column_i``."""
    tidy = F.transform(cells, lambda h: text.strip(F.translate(h, "\r\n", "  ")))
    return F.transform(
        tidy, lambda h, i: F.when(F.length(h) > 0, h).otherwise(F.concat(F.lit("Column_"), (i + 1).cast("string")))
    )


def distinct_header(names: Column) -> Column:
    """Repeated names get a number: ``Price``, ``Price_1``, ``Price_2``."""

    def numbered(h: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == h))
        return F.when(earlier == 0, h).otherwise(F.concat(h, F.lit("_"), earlier.cast("string")))

    return F.transform(names, numbered)


def clean_cells(cells: Column, width: Column) -> Column:
    """Cells with spaces collapsed and blanks null, padded or cut to ``width``."""
    tidy = F.transform(cells, lambda c: text.blank_to_null(c, text.collapse_spaces(text.strip(c))))
    padding = F.array_repeat(F.lit(None).cast("string"), F.greatest(width - F.size(cells), F.lit(0)))
    return F.slice(F.concat(tidy, padding), F.lit(1), width)


def headers(grid: DataFrame) -> DataFrame:
    """One row per extracted table: its first row number and clean column names."""
    top = grid.groupBy(*KEYS).agg(F.min("row_no").alias("header_no"), F.min_by("cells", "row_no").alias("cells"))
    plain = top.select(*KEYS, "header_no", plain_header(F.col("cells")).alias("plain"))
    return plain.select(*KEYS, "header_no", distinct_header(F.col("plain")).alias("names"))


def data_rows(grid: DataFrame) -> DataFrame:
    """Data rows of every table with clean cells: (keys, row_no, names, cells)."""
    joined = grid.join(headers(grid), KEYS)
    return joined.filter(F.col("row_no") > F.col("header_no")).select(
        *KEYS, "row_no", "names", clean_cells(F.col("cells"), F.size("names")).alias("cells")
    )


def table_name(page: Column, table: Column, names: Column) -> Column:
    """``Page p - Table t (tag)``; the tag is the first telling column name, cut short."""
    telling = F.filter(names, lambda n: ~n.startswith("Column_") & (F.length(text.strip(n)) > 1))
    head = text.strip(F.substring_index(F.try_element_at(telling, F.lit(1)), "(", 1))
    tag = text.strip(F.left(head, F.lit(18)))
    plain = F.concat(F.lit("Page "), page.cast("string"), F.lit(" - Table "), table.cast("string"))
    return F.when(F.length(tag) > 0, F.concat(plain, F.lit(" ("), tag, F.lit(")"))).otherwise(plain)


def _tables(grid: DataFrame, preview_rows: int = PREVIEW_ROWS) -> DataFrame:
    """One row per table that has data, written: (keys, rows, header_no, names, top), ``top`` its first rows with the header."""
    counted = grid.groupBy(*KEYS).agg((F.count(F.lit(1)) - 1).alias("rows")).filter("rows > 0")
    nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy("row_no"))
    first = grid.select(*KEYS, "row_no", "cells").withColumn("nth", nth).filter(F.col("nth") <= preview_rows + 1)
    top = first.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("nth", "cells"))).getField("cells").alias("top"), F.min("row_no").alias("header_no"))
    plain = counted.join(top, KEYS).withColumn("plain", plain_header(F.col("top")[0]))
    return written_table(plain.withColumn("names", distinct_header(F.col("plain"))).drop("plain"), "grid-tables")


def inspect_grids(grid: DataFrame, preview_rows: int = PREVIEW_ROWS) -> DataFrame:
    """One row per table that has data: id, name, sizes, names, first rows, document totals."""
    tables = _tables(grid, preview_rows)
    shown = F.transform(F.slice("top", 2, preview_rows), lambda r: clean_cells(r, F.size("names")))
    document = tables.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_tables"), (F.min("names") == F.max("names")).alias("columns_match")
    )
    page, table = F.col("page"), F.col("table")
    table_id = F.concat(F.lit("page_"), page.cast("string"), F.lit("_table_"), table.cast("string"))
    return tables.join(document, "doc_id").select(
        "doc_id",
        table_id.alias("id"),
        table_name(page, table, F.col("names")).alias("name"),
        page.alias("page_number"),
        table.alias("table_index"),
        "rows",
        F.size("names").alias("columns"),
        F.col("names").alias("column_names"),
        shown.alias("preview"),
        "total_tables",
        "columns_match",
    )


def grid_tables(grid: DataFrame, doc_id) -> dict[str, DataFrame]:
    """The tables of one document as a table set, in page order, empty ones left out."""
    mine = grid.filter(F.col("doc_id") == doc_id)
    tables = {}
    for t in table_heads(mine).collect():
        part = mine.filter((F.col("page") == t["page"]) & (F.col("table") == t["table"]) & (F.col("row_no") > t["header_no"]))
        cells = clean_cells(F.col("cells"), F.lit(len(t["names"])))
        rows = part.select((F.col("row_no") - t["header_no"] - 1).cast("bigint").alias(ROW_INDEX), cells.alias("c"))
        tables[t["name"]] = rows.select(ROW_INDEX, *[F.col("c")[i].alias(n) for i, n in enumerate(t["names"])])
    return tables


def table_heads(grid: DataFrame) -> DataFrame:
    """(keys, header_no, names, name) of every table that has data, in page order."""
    named = _tables(grid, 0).select(*KEYS, "header_no", "names", table_name(F.col("page"), F.col("table"), F.col("names")).alias("name"))
    return named.orderBy(*KEYS)


def rows_by_header(grid: DataFrame, heads: DataFrame) -> dict[tuple, DataFrame]:
    """The rows of all tables, one frame for each header that occurs: (``table_name``, row index within it, columns...).

    Tables of one header come from one scan, however many they are."""
    signatures = [r["names"] for r in heads.select("names").distinct().collect()]
    known = heads.select(*KEYS, "header_no", F.col("names").alias("head"), F.col("name").alias("table_name"))
    joined = grid.join(known, KEYS).filter(F.col("row_no") > F.col("header_no"))
    frames = {}
    for names in signatures:
        mine = joined.filter(F.col("head") == F.array(*[F.lit(n) for n in names]))
        cells = clean_cells(F.col("cells"), F.lit(len(names)))
        rows = mine.select("table_name", (F.col("row_no") - F.col("header_no") - 1).cast("bigint").alias(ROW_INDEX), cells.alias("c"))
        frames[tuple(names)] = rows.select("table_name", ROW_INDEX, *[F.col("c")[i].alias(n) for i, n in enumerate(names)])
    return frames
