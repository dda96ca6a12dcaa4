"""A Bloom-style filter of hashes with a fixed size: which rows of a second scan are worth moving.

``build`` sets one bit for each hash in a table of at most ``2**SLOT_BITS`` words of 64 bits, so the table
has a bound however many hashes there are, and may be broadcast. ``prune`` keeps the rows whose bit is
set: every row of a hash that was built in, and a share of others that grows as the table fills (all of
them at worst). So it saves shuffles and never decides; the rows it keeps are joined on the real keys. ``divide`` gives both
kinds, for an anti join that moves only what it may drop.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SLOT_BITS = 18


def _slot(hashed: Column, slot_bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - slot_bits)


def _bit(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(63)).cast("int")


def build(hashes: DataFrame, hashed: str, slot_bits: int = SLOT_BITS) -> DataFrame:
    """(slot, bits) of the 64-bit hashes in one column; nulls are left out."""
    known = hashes.where(F.col(hashed).isNotNull())
    return known.groupBy(_slot(F.col(hashed), slot_bits).alias("_slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col(hashed)))).alias("_bits"))


def prune(rows: DataFrame, hashed: str, built: DataFrame) -> DataFrame:
    """The rows whose hash may be one that was built in."""
    known = rows.withColumn("_slot", _slot(F.col(hashed), SLOT_BITS))
    return known.join(F.broadcast(built), "_slot").where(F.call_function("getbit", F.col("_bits"), _bit(F.col(hashed))) == 1).drop("_slot", "_bits")


def divide(rows: DataFrame, hashed: str, built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash is surely not in the filter, and the others. Nulls are among the first."""
    known = rows.withColumn("_slot", _slot(F.col(hashed), SLOT_BITS)).join(F.broadcast(built), "_slot", "left")
    told = known.withColumn("_may", F.coalesce(F.call_function("getbit", F.col("_bits"), _bit(F.col(hashed))) == 1, F.lit(False)))
    return told.where(~F.col("_may")).drop("_slot", "_bits", "_may"), told.where("_may").drop("_slot", "_bits", "_may")


def as_array(built: DataFrame, slot_bits: int = SLOT_BITS) -> np.ndarray:
    """The whole filter, for tasks in Python: 8 bytes a slot, on the driver too."""
    words = np.zeros(1 << slot_bits, np.uint64)
    rows = built.toArrow()
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return words


def holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) may be in a filter from ``as_array``."""
    bits = np.uint64(64 - (len(words).bit_length() - 1))
    return (words[hashes >> bits] >> (hashes & np.uint64(63))) & np.uint64(1) == 1
