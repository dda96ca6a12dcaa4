"""Running totals and dense row numbers over a table of any size.

The same cut as in the ordered fill: rows in buckets, and buckets in blocks, blocks in larger
ones and so on while there are many. No window spans more than one bucket or 2^20 of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscrub.functions.columns import ROW_INDEX, col, require_index

BUCKET_BITS = 16
BLOCK_BITS = 20


def levels(df: DataFrame, position: Column, bucket_bits: int, block_bits: int) -> int:
    """How often buckets must be taken together into blocks until one list of them is short: 0 for dense
    indexes of usual tables, more for sparse ones. One small job over the index alone."""
    low, high = df.agg(F.min(position), F.max(position)).first()
    if low is None:
        return 0
    low, high, n = low >> bucket_bits, high >> bucket_bits, 0
    while high - low >= 1 << block_bits:
        low, high, n = low >> block_bits, high >> block_bits, n + 1
    return n


def _offsets(buckets: DataFrame, keys: list[str], bits: int, depth: int) -> DataFrame:
    """(keys, _bucket, _offset): the sum of all buckets before each, in blocks of blocks ``depth`` deep."""
    by = [col(k) for k in keys]

    def ahead(*group):
        return F.coalesce(F.sum("_sum").over(Window.partitionBy(*by, *group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if not depth:
        return buckets.select(*by, "_bucket", ahead().alias("_offset"))
    placed = buckets.withColumn("_block", F.shiftright("_bucket", bits))
    blocks = placed.groupBy(*by, F.col("_block").alias("_up")).agg(F.sum("_sum").alias("_sum")).withColumnRenamed("_up", "_bucket")
    above = _offsets(blocks, keys, bits, depth - 1).withColumnsRenamed({"_bucket": "_block", "_offset": "_above"})
    within = placed.select(*by, "_bucket", "_block", ahead("_block").alias("_ahead"))
    return within.join(above, [*keys, "_block"]).select(*by, "_bucket", (F.col("_ahead") + F.col("_above")).alias("_offset"))


def running_total(
    df: DataFrame,
    value: Column,
    out: str,
    position: str = ROW_INDEX,
    keys: Iterable[str] = (),
    bucket_bits: int = BUCKET_BITS,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one, per key, by ``position``."""
    keys = list(keys)
    bucket = F.shiftright(col(position), bucket_bits)
    before = Window.partitionBy

    buckets = df.groupBy(*[col(k) for k in keys], bucket.alias("_bucket")).agg(F.sum(value).alias("_sum"))
    offsets = _offsets(buckets, keys, block_bits, levels(df, col(position).cast("bigint"), bucket_bits, block_bits))
    in_bucket = before(*[col(k) for k in keys], "_bucket").orderBy(col(position)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = df.withColumn("_bucket", bucket)
    summed = placed.withColumn("_within", F.coalesce(F.sum(value).over(in_bucket), F.lit(0)))
    joined = summed.join(offsets, [*keys, "_bucket"])
    return joined.select(*[col(c) for c in df.columns], (F.col("_within") + F.col("_offset")).alias(out))


def dense_index(df: DataFrame, index: str = ROW_INDEX) -> DataFrame:
    """The row index numbered anew as 0, 1, 2... in the same order."""
    require_index(df, index)
    numbered = running_total(df, F.lit(1), "_dense", position=index)
    return numbered.select([F.col("_dense").cast("bigint").alias(c) if c == index else col(c) for c in df.columns])
