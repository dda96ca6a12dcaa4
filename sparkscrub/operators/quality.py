"""Quality score and the whole profile of a dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions.columns import ROW_INDEX
from sparkscrub.operators.dedupe import duplicate_summary
from sparkscrub.operators.null_profile import analyze_nulls, dataset_nulls
from sparkscrub.operators.type_profile import detect_column_types


def quality_score(nulls: DataFrame, duplicates: DataFrame, types: DataFrame) -> DataFrame:
    """One row: the three part scores, the weighted score, the grade and the issue counts.

    ``nulls`` is the dataset rollup, ``duplicates`` the summary, ``types`` one row per column.
    """
    facts = ("rows", "columns", "null_pct", "nulls", "dup_pct", "dups", "issues")

    def fact(df: DataFrame, **known) -> DataFrame:
        return df.select([known.get(f, F.lit(None)).cast("double").alias(f) for f in facts])

    parts = (
        fact(
            nulls, rows=F.col("total_rows"), columns=F.col("total_columns"), nulls=F.col("total_nulls"),
            null_pct=F.col("overall_null_percentage"),
        )
        .unionByName(fact(duplicates, dups=F.col("duplicate_rows"), dup_pct=F.col("duplicate_percentage")))
        .unionByName(fact(types.agg(F.count_if(F.col("status") == "⚠").alias("k")), issues=F.col("k")))
    )
    one = parts.agg(*[F.max(f).alias(f) for f in facts]).withColumns(
        {
            "nothing": (F.coalesce("rows", F.lit(0)) == 0) | (F.coalesce("columns", F.lit(0)) == 0),
            "c": F.greatest(F.lit(0.0), 100 - F.col("null_pct") * 2.5),
            "u": F.greatest(F.lit(0.0), 100 - F.col("dup_pct") * 3.0),
            "t": F.greatest(F.lit(0.0), 100 - F.col("issues") / F.nullif("columns", F.lit(0)) * 50.0),
        }
    )
    composite = F.col("c") * 0.4 + F.col("u") * 0.3 + F.col("t") * 0.3
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), composite)), 0).cast("int")
    grade = (
        F.when(F.col("score") >= 90, "Excellent")
        .when(F.col("score") >= 75, "Good")
        .when(F.col("score") >= 60, "Fair")
        .otherwise("Needs Attention")
    )
    nothing = F.col("nothing")
    total_issues = F.col("issues") + (F.col("dups") > 0).cast("int") + (F.col("nulls") > 0).cast("int")

    def part(name: str):
        return F.when(nothing, F.lit(100.0)).otherwise(F.bround(name, 1))

    return one.withColumn("score", F.when(nothing, 100).otherwise(score)).select(
        "score",
        F.when(nothing, "N/A").otherwise(grade).alias("grade"),
        part("c").alias("completeness_score"),
        part("u").alias("uniqueness_score"),
        part("t").alias("type_integrity_score"),
        F.when(nothing, 0).otherwise(F.col("issues")).cast("int").alias("columns_with_issues"),
        F.when(nothing, 0).otherwise(total_issues).cast("int").alias("total_issues"),
    )


@dataclass(frozen=True)
class Profile:
    columns: DataFrame
    """Nulls, blanks, distinct values per column."""
    dataset: DataFrame
    """One row of totals."""
    duplicates: DataFrame
    types: DataFrame
    quality: DataFrame


def profile_dataset(
    df: DataFrame,
    index: str = ROW_INDEX,
    mode: str = "full",
    word_match: bool = False,
    approx_distinct: bool = False,
    one_scan: bool | None = None,
) -> Profile:
    """All profile parts, each lazy: ask only for the part you need."""
    columns = analyze_nulls(df, approx_distinct=approx_distinct, one_scan=one_scan, index=index)
    dataset = dataset_nulls(columns)
    duplicates = duplicate_summary(df, index=index)
    types = detect_column_types(df, mode=mode, word_match=word_match, index=index)
    return Profile(columns, dataset, duplicates, types, quality_score(dataset, duplicates, types))
