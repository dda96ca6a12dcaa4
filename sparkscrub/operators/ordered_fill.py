"""Forward and backward fill in row order, without a window over the whole table.

Rows are cut into buckets by their index. A window fills within each bucket; what enters a
bucket from above is found on a table with one row per bucket, which is itself cut into
blocks, and these into larger ones, while there are many. So no task sees more than one bucket
of rows or 2^20 buckets.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscrub.functions.columns import ROW_INDEX, col, data_columns, dtype, is_missing, nan_to_null, require_index
from sparkscrub.operators.running import levels

BUCKET_BITS = 16
BLOCK_BITS = 20


def _entering(buckets: DataFrame, carried: list[str], bits: int, depth: int) -> DataFrame:
    """Per bucket, the last value of every carried column in the buckets before it."""
    ahead = Window.partitionBy("block") if depth else Window.partitionBy()
    ahead = ahead.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("block", F.shiftright("bucket", bits))
    within = placed.select("bucket", "block", *[F.last(c, ignorenulls=True).over(ahead).alias(c) for c in carried])
    if not depth:
        return within.drop("block")
    blocks = placed.groupBy("block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("bucket"))).alias(c) for c in carried]
    )
    above = _entering(blocks.withColumnRenamed("block", "bucket"), carried, bits, depth - 1)
    above = above.select(F.col("bucket").alias("block"), *[F.col(c).alias(f"{c}_above") for c in carried])
    return within.join(above, "block", "left").select(
        "bucket", *[F.coalesce(c, f"{c}_above").alias(c) for c in carried]
    )


def ordered_fill(
    df: DataFrame,
    columns: Iterable[str],
    backward: bool = False,
    index: str = ROW_INDEX,
    bucket_bits: int = BUCKET_BITS,
    block_bits: int = BLOCK_BITS,
    own: bool = True,
) -> DataFrame:
    """Fill missing cells from the nearest value above (or below); the table's edge stays null.

    Without ``own`` a cell's own value does not count: every cell gets the nearest other one.
    """
    require_index(df, index)
    names = data_columns(df, columns)
    position = col(index).cast("bigint")
    if backward:
        position = F.bitwise_not(position)
    bucket = F.shiftright(position, bucket_bits)
    carried = [f"_carry_{i}" for i in range(len(names))]

    def last_of(name: str):
        c = col(name)
        return F.max_by(c, F.when(~is_missing(c, dtype(df, name)), position))

    buckets = df.groupBy(bucket.alias("bucket")).agg(*[last_of(n).alias(k) for n, k in zip(names, carried)])
    depth = levels(df, position, bucket_bits, block_bits)
    entering = _entering(buckets, carried, block_bits, depth).withColumnRenamed("bucket", "_bucket")

    up_to_here = Window.partitionBy("_bucket").orderBy("_position").rowsBetween(
        Window.unboundedPreceding, 0 if own else -1
    )
    placed = df.withColumns({"_bucket": bucket, "_position": position})
    filled = placed.withColumns(
        {n: F.last(nan_to_null(col(n), dtype(df, n)), ignorenulls=True).over(up_to_here) for n in names}
    )
    joined = filled.join(entering, "_bucket", "left")
    values = {n: F.coalesce(col(n), F.col(k)) for n, k in zip(names, carried)}
    return joined.select([values[n].alias(n) if n in values else col(n) for n in df.columns])


def forward_fill(df: DataFrame, columns: Iterable[str], index: str = ROW_INDEX) -> DataFrame:
    return ordered_fill(df, columns, backward=False, index=index)


def backward_fill(df: DataFrame, columns: Iterable[str], index: str = ROW_INDEX) -> DataFrame:
    return ordered_fill(df, columns, backward=True, index=index)
