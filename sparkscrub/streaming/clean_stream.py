"""The cell-wise steps of a recipe on a streaming DataFrame.

They are projections without state, so a stream needs no watermark for them. Steps that
look at other rows (duplicates, fills by neighbour or statistic) are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkscrub.plans.recipe import Recipe


def clean_stream(stream: DataFrame, recipe: Recipe) -> DataFrame:
    if not recipe.streamable:
        bad = [s.op for s in recipe.steps if not Recipe((s,)).streamable]
        raise ValueError(f"these steps need the whole table: {bad}")
    return recipe.replay(stream)


def write_clean_stream(
    stream: DataFrame, recipe: Recipe, path: str, checkpoint: str, fmt: str = "parquet", **trigger
) -> StreamingQuery:
    """Append cleaned rows to files; the checkpoint makes every row arrive once."""
    writer = clean_stream(stream, recipe).writeStream.format(fmt).outputMode("append")
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.option("checkpointLocation", checkpoint).start(path)
