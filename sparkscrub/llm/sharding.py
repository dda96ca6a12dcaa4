"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

A uniform shuffle of n rows sends from source partition i to shard j a number of rows that follows
the multivariate hypergeometric law with the partition sizes and the shard sizes as margins. That
matrix is drawn exactly on the driver (its size is partitions times shards, whatever the rows). Each
partition is then permuted locally, its first m[i][0] rows go to shard 0, the next m[i][1] to shard 1
and so on, and each shard is permuted again after the exchange.

Scale: the rows are written once with a row number and the number of the task that read them, since
what follows must see the same partitions each time; a caller passes the columns that shall travel.
More than ``MAX_PARTITIONS`` reading tasks are folded onto that many partitions, which bounds the
matrix. Local order is a window per partition, and a shard's order is a window per shard *and* range
of the random key, so no task holds a shard; the ranges' offsets are a small prefix sum.

Law: ``rows``, shard sizes at most one apart. Defined results: null or repeated rows and ids are rows
like any other; with fewer rows than shards the first shards get one row each; an empty table gives
an empty result. The caller's columns are kept in one struct, so no name can clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from sparkscrub.llm.common import random_key, shared

MAX_PARTITIONS = 4096
#: Rows that one window of the second permutation orders.
RANGE_ROWS = 100_000
_NUMPY_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement. Above numpy's limit: inversion around the mode."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(draws, good)
    total = good + bad
    mean = draws * good / total
    sd = (mean * (bad / total) * max(0.0, (total - draws) / (total - 1))) ** 0.5
    a, b = max(low, int(mean - 12 * sd) - 12), min(high, int(mean + 12 * sd) + 12)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))  # log p(k+1) - log p(k)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(sizes: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows from partition i to shard j, drawn exactly; margins are ``sizes`` and ``shards``.

    Partitions are halved again and again; each half gets its part of every shard's rows.
    """
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(sizes), len(shards)), dtype=np.int64)
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    stack = [(0, len(sizes), np.asarray(shards, dtype=np.int64))] if len(sizes) else []
    while stack:
        lo, hi, colours = stack.pop()
        if hi - lo == 1:
            matrix[lo] = colours
            continue
        mid = (lo + hi) // 2
        left, draws, rest = np.zeros_like(colours), int(prefix[mid] - prefix[lo]), int(colours.sum())
        for j, c in enumerate(colours):
            left[j] = hypergeometric(rng, int(c), rest - int(c), draws)
            draws, rest = draws - int(left[j]), rest - int(c)
        stack += [(lo, mid, left), (mid, hi, colours - left)]
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def shuffle_to_shards(df: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """The rows of ``df`` as struct ``row``, with ``shard`` and ``slot`` (0, 1, ... within the shard)."""
    spark = df.sparkSession
    held = shared(df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"),
        F.pmod(F.spark_partition_id(), F.lit(MAX_PARTITIONS)).alias("part"),
        F.monotonically_increasing_id().alias("rid"),
    ), "shard-rows")
    counts = held.groupBy("part").count().orderBy("part").collect()  # MAX_PARTITIONS rows at most
    sizes = [r["count"] for r in counts]
    matrix = communication_matrix(sizes, shard_sizes(sum(sizes), shards), seed)
    plan = spark.createDataFrame(
        [(r["part"], [int(x) for x in np.cumsum(m)]) for r, m in zip(counts, matrix)], "part int, ends array<long>")
    local = Window.partitionBy("part").orderBy(random_key(seed, F.col("rid")), "rid")
    ranked = held.withColumn("place", F.row_number().over(local) - 1)
    sent = ranked.join(F.broadcast(plan), "part").select(
        "row", "rid", F.size(F.filter("ends", lambda e: e <= F.col("place"))).alias("shard"))
    ranges = max(1, -(-sum(sizes) // shards // RANGE_ROWS))
    key = random_key(seed + 1, F.col("rid"))
    sent = sent.withColumn("key", key).withColumn("range", F.pmod(F.shiftrightunsigned("key", 16), F.lit(ranges)))
    sent = shared(sent, "shard-sent")
    starts = (sent.groupBy("shard", "range").count()
              .withColumn("start", F.sum("count").over(Window.partitionBy("shard").orderBy("range")) - F.col("count"))
              .select("shard", "range", "start"))
    within = Window.partitionBy("shard", "range").orderBy("key", "rid")
    placed = sent.withColumn("at", F.row_number().over(within) - 1)
    return placed.join(starts, ["shard", "range"]).select(
        "row", F.col("shard").cast("int"), (F.col("start") + F.col("at")).cast("long").alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, its files in slot order: rows are dealt by ranges of (shard, slot)."""
    rows = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select("shard", "slot", "row.*").write.partitionBy("shard").parquet(path)
