"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

toxicity -> line dedup -> near duplicates -> secrets -> packing. All but the last return the columns of
``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkscrub.functions.columns import ROW_INDEX
from sparkscrub.llm import line_dedup, near_dup, packing, secret_scan, toxicity
from sparkscrub.llm.common import load, shared
from sparkscrub.operators import hash_filter
from sparkscrub.sources.rowid import parquet_place, with_file_index


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of rows not held out."""
    scored = _score(docs, load(spark, sf_dir, "labels"))
    return scored.where(F.col("toxicity") < toxicity.DECIDE_AT).select("row.*")


def _score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` as struct ``row``, each with the score of its text: one pass, no join."""
    model = toxicity.learn(docs, labels, ~toxicity.is_held_out(F.col("doc_id")))
    return toxicity.with_score(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a document of which no word is left goes, unless it had none before."""
    cleaned = line_dedup.remove_repeated_passages(docs)
    emptied = (F.col("n_removed") > 0) & ~F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    return cleaned.where(~emptied).select(*_with_text(docs, "row", F.col("text")))


def _with_text(docs: DataFrame, row: str, text) -> list:
    """The columns of ``docs`` from a struct, with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new[c].alias(c) if c in new else F.col(row)[c].alias(c) for c in docs.columns]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, null ids last, then of the first place.

    Rows are known by their place in the files of ``docs`` (the stage's input is a written table), as ids may be null
    or come again. Texts without words are in no group. Only rows that may be dropped are moved.
    """
    placed = _placed(docs)
    found = near_dup.near_duplicates(placed.select("key", F.col("row.text").alias("text")), id_col="key")
    groups = found.select(F.col("doc_id").alias("key"), "component_id").join(placed.select("key", F.col("row.doc_id").alias("id")).hint("merge"), "key")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    ordered = shared(groups.select("component_id", "key", first.alias("place")), "pipeline-groups")
    least = ordered.groupBy("component_id").agg(F.min("place").alias("least")).hint("merge")
    goes = ordered.join(least, "component_id").where("key != least.key").select("key", F.xxhash64("key").alias("hash"))
    goes = shared(goes, "pipeline-goes")
    stays, others = hash_filter.divide(placed.withColumn("hash", F.xxhash64("key")), "hash", hash_filter.build(goes, "hash"))
    others = others.join(goes.select("key").hint("merge"), "key", "left_anti")
    return stays.select("row.*").unionByName(others.select("row.*"))


def _placed(docs: DataFrame) -> DataFrame:
    """``key`` and ``row`` of every row: its place in the files it is read from. What is no table in files is written first."""
    try:
        docs.select("_metadata.row_index").schema
    except AnalysisException:
        docs = shared(docs, "pipeline-docs")
    indexed = with_file_index(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")), parquet_place())
    return indexed.select(F.col(ROW_INDEX).alias("key"), "row")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its bin."""
    return packing.pack(docs).select("doc_id", "piece", "first_word", "n_words", "bin", "bin_offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("best_fit_packing", pack),
]

#: Dictionary training, min-hashing and best fit are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
