"""A row index that follows file order.

The index of a row is (rank of its file by path, place in the file). The place comes from
the scan itself, so no row is counted and nothing is sorted:

* parquet knows the row number in the file;
* text has the start of the block a row was read from, plus the row's number in its task.
  A block of full size is always alone in its task, and a smaller one is the last of its
  file, so these places grow along the file and never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions.columns import ROW_INDEX

PLACE_BITS = 40
BROADCAST_FILES = 50_000


def text_place() -> Column:
    start = F.col("_metadata.file_block_start")
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = start + in_task + F.when(start > 0, 1).otherwise(0)
    too_far = F.raise_error(F.lit(f"a text file of more than 2^{PLACE_BITS} bytes: split it")).cast("bigint")
    return F.when(place < F.lit(1 << PLACE_BITS), place).otherwise(too_far)


def parquet_place() -> Column:
    return F.col("_metadata.row_index")


def _plain_path(path: Column) -> Column:
    """A local path comes as ``file:/x`` from one reader and as ``file:///x`` from another."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def with_file_index(df: DataFrame, place: Column, files: list[str] | None = None) -> DataFrame:
    """Add the file-order index. ``df`` must come straight from a file reader.

    ``files`` is the whole list to rank by, where ``df`` reads only some of them.
    """
    files = sorted(files or df.inputFiles())
    placed = df.select("*", _plain_path(F.col("_metadata.file_path")).alias("_file"), place.alias("_place"))
    if len(files) <= 1:
        return placed.withColumnRenamed("_place", ROW_INDEX).drop("_file")
    ranks = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(files)], "_path string, _rank bigint")
    ranks = ranks.select(_plain_path(F.col("_path")).alias("_file"), "_rank")
    if len(files) <= BROADCAST_FILES:
        ranks = F.broadcast(ranks)
    ranked = placed.join(ranks, "_file", "left")
    index = F.shiftleft(F.col("_rank"), PLACE_BITS) + F.col("_place")
    return ranked.withColumn(ROW_INDEX, index).drop("_file", "_place", "_rank")
