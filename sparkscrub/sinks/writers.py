"""Parquet, CSV and JSON output, for one table or a table set."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions.columns import ROW_INDEX, col, is_float, is_nested
from sparkscrub.functions.numbers import finite_or_null
from sparkscrub.operators.tables import DISJOINT, TableSet, schemas_match, union_tables
from sparkscrub.sources import grids

_NOT_STORABLE = (T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.VariantType)


def storable(df: DataFrame) -> DataFrame:
    """Types parquet cannot hold become text; the row index is left out."""

    def stored(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.VariantType):
            return F.to_json(col(f.name))
        return col(f.name).cast("string") if isinstance(f.dataType, _NOT_STORABLE) else col(f.name)

    return df.select([stored(f).alias(f.name) for f in df.schema if f.name != ROW_INDEX])


def flat(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, for formats that only know plain cells."""
    plain = storable(df)
    cells = [(F.to_json(col(f.name)) if is_nested(f.dataType) else col(f.name)).alias(f.name) for f in plain.schema]
    return plain.select(cells)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and the infinities as null, inside arrays and structs too."""

    def safe(c: Column, dt: T.DataType) -> Column:
        if is_float(dt):
            return finite_or_null(c)
        if isinstance(dt, T.ArrayType):
            return F.transform(c, lambda x: safe(x, dt.elementType))
        if isinstance(dt, T.StructType):
            fields = [safe(c.getField(f.name), f.dataType).alias(f.name) for f in dt]
            return F.when(c.isNotNull(), F.struct(*fields))
        if isinstance(dt, T.MapType):
            return F.transform_values(c, lambda _, v: safe(v, dt.valueType))
        return c

    return df.select([safe(col(f.name), f.dataType).alias(f.name) for f in df.schema if f.name != ROW_INDEX])


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    storable(df).write.mode(mode).partitionBy(*by).option("compression", compression).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    """Header, no row index, spaces kept, quotes doubled as the reader expects them; a folder for each value of ``by``."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    flat(df).write.mode(mode).partitionBy(*by).options(**options).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    json_safe(df).write.mode(mode).partitionBy(*by).option("ignoreNullFields", "false").json(path)


_WRITERS = {"parquet": write_parquet, "csv": write_csv, "json": write_json}


def directory_names(names: list[str]) -> dict[str, str]:
    """A safe, distinct directory name for each table name."""
    safe: dict[str, str] = {}
    for i, name in enumerate(names):
        plain = re.sub(r"\s+", "_", re.sub(r"[^\w\s-]", "", name).strip()) or f"Table_{i + 1}"
        safe[name] = plain if plain not in safe.values() else f"{plain}_{i + 1}"
    return safe


def write_table_set(tables: TableSet, directory: str, fmt: str = "parquet", mode: str = "errorifexists") -> dict[str, str]:
    """Every table into its own sub-directory; the disjoint union pseudo-table is skipped."""
    names = directory_names([n for n in tables if n != DISJOINT])
    paths = {n: f"{directory.rstrip('/')}/{d}" for n, d in names.items()}
    for name, path in paths.items():
        _WRITERS[fmt](tables[name], path, mode=mode)
    return paths


def write_extracted(tables: TableSet, directory: str, fmt: str = "csv", mode: str = "errorifexists") -> dict[str, str]:
    """Extracted tables: one table if all columns are equal, else one per table."""
    if schemas_match(tables.values()):
        tables = {"converted": union_tables(tables.values())}
    return write_table_set(tables, directory, fmt, mode)


def write_grid(grid: DataFrame, doc_id, directory: str, fmt: str = "csv", mode: str = "errorifexists") -> dict[str, str]:
    """The extracted tables of one document: one table if all headers are equal, else a folder for each table.

    One scan and one write for each header that occurs, whatever the number of tables."""
    mine = grid.filter(F.col("doc_id") == doc_id)
    heads = grids.table_heads(mine)
    frames = grids.rows_by_header(mine, heads)
    base = directory.rstrip("/")
    if len(frames) == 1:
        _WRITERS[fmt](next(iter(frames.values())).drop("table_name"), f"{base}/converted", mode=mode)
        return {"converted": f"{base}/converted"}
    paths = {}
    folders = directory_names([r["name"] for r in heads.collect()])
    labels = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair]) if folders else None
    for k, (names, df) in enumerate(frames.items()):
        placed = df.withColumn("_folder", F.element_at(labels, F.col("table_name"))).drop("table_name")
        _WRITERS[fmt](placed, f"{base}/header_{k}", mode=mode, by=("_folder",))
        here = {r["name"] for r in heads.filter(F.col("names") == F.array(*[F.lit(n) for n in names])).collect()}
        paths |= {n: f"{base}/header_{k}/_folder={d}" for n, d in folders.items() if n in here}
    return paths


def write(df: DataFrame, path: str, fmt: str, **options) -> None:
    _WRITERS[fmt](df, path, **options)


def export_info(df: DataFrame, path: str, fmt: str, compression: str | None = None) -> Mapping[str, object]:
    """Facts about a written table: bytes and rows are read back from the files."""
    from sparkscrub.sources.readers import file_info

    spark = df.sparkSession
    if fmt == "parquet":
        written = spark.read.parquet(path)
    else:
        written = spark.read.options(header=True).csv(path) if fmt == "csv" else spark.read.json(path)
    info = file_info(written).first().asDict()
    return {"format": fmt, "path": path, "compression": compression, **info}
