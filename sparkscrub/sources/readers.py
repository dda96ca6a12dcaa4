"""Format dispatch, parquet, table sets and file facts."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscrub.functions.columns import ROW_INDEX
from sparkscrub.sources.delimited import read_delimited
from sparkscrub.sources.rowid import parquet_place, with_file_index
from sparkscrub.sources.sqldump import read_sql_dump

# File name endings and the reader for each.
FORMATS = {
    ".csv": "delimited",
    ".tsv": "delimited",
    ".txt": "delimited",
    ".parquet": "parquet",
    ".pq": "parquet",
    ".sql": "sql",
}


def format_of(path: str) -> str | None:
    """The reader for a file name, by its ending in any case; None if there is none."""
    return FORMATS.get(posixpath.splitext(path)[1].lower())


def read_parquet(spark: SparkSession, paths: str | list[str], row_index: bool = True) -> DataFrame:
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return with_file_index(df, parquet_place()) if row_index else df


def read_table(spark: SparkSession, path: str, table: str | None = None, row_index: bool = True) -> DataFrame:
    """Read one path by the format its name tells; ``table`` picks one from a dump."""
    kind = format_of(path)
    if kind is None:
        raise ValueError(f"unsupported file type: {path}")
    if kind == "parquet":
        return read_parquet(spark, path, row_index)
    if kind == "sql":
        dump = read_sql_dump(spark, path)
        name = dump.pick(table)
        df = dump.table(name)
    else:
        df = read_delimited(spark, path).data
    return df if row_index else df.drop(ROW_INDEX)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input that comes in fewer pieces than there are cores.

    A file of one row group cannot be split by the scan, so the work on its rows would run
    in one task. An input with enough pieces is left alone: no shuffle at scale. Call it on
    a table straight from a reader, and only where the work per row is heavy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """Every file below a directory. Only the listing is read, no content."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return sorted(listing.inputFiles())


def read_table_set(
    spark: SparkSession, directory: str, names: Iterable[str] | None = None, row_index: bool = True
) -> dict[str, DataFrame]:
    """A directory as a set of tables, like the sheets of a workbook.

    Each file, or the files of one format in each sub-directory, is a table named after it. Where a name has
    several formats, the first one's table keeps the name and the others add their format: ``a``, ``a (parquet)``.
    """
    found: dict[tuple[str, str], list[str]] = {}
    root = directory.rstrip("/").split(":")[-1].lstrip("/")
    for path in list_files(spark, directory):
        below = path.split(root + "/", 1)[-1]
        head, _, rest = below.partition("/")
        name = head if rest else posixpath.splitext(head)[0]
        if format_of(path) in ("delimited", "parquet"):
            found.setdefault((name, format_of(path)), []).append(path)
    members: dict[str, list[str]] = {}
    for (name, kind), paths in found.items():
        members[f"{name} ({kind})" if name in members else name] = paths
    wanted = list(members) if names is None else [n for n in names if n in members]
    tables = {}
    for name in wanted:
        if format_of(members[name][0]) == "parquet":
            tables[name] = read_parquet(spark, members[name], row_index)
        else:
            df = read_delimited(spark, members[name]).data
            tables[name] = df if row_index else df.drop(ROW_INDEX)
    return tables


def file_info(df: DataFrame) -> DataFrame:
    """One row: files, bytes, rows, columns, column names of a DataFrame read from files."""
    names = [c for c in df.columns if c != ROW_INDEX]
    files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.max("_metadata.file_size").alias("bytes"), F.count(F.lit(1)).alias("n")
    )
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("file_size_bytes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(names)).alias("columns"),
        F.array(*[F.lit(n) for n in names]).alias("column_names"),
    )
