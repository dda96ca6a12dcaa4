"""The registered queries of this subpackage, each over its whole table with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkscrub.llm import (
    collocations, filter_audit, kmeans_tree, line_dedup, near_dup, packing, pivot_index, quality_rules, secret_scan, sharding, subword_sampling, toxicity, url_filter,
)
from sparkscrub.llm.common import load
from sparkscrub.llm.sql import SQL

URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rule and verdict; a page is labelled bad where its document is of low quality."""
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return url_filter.judge_urls(load(spark, sf_dir, "pages"), labels, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "template")


def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judge_documents(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its bin."""
    return packing.pack(load(spark, sf_dir, "documents")).select("doc_id", "piece", "first_word", "n_words", "bin", "bin_offset")


def uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    text = F.coalesce("text", F.lit(""))
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shuffle_to_shards(docs, 16).select(
        "row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages."""
    cleaned = line_dedup.remove_repeated_passages(load(spark, sf_dir, "documents"))
    return cleaned.select("row.doc_id", "n_lines", "n_removed", "text")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.digest(secret_scan.find_secrets(load(spark, sf_dir, "documents")))


def toxic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document, and whether it stays."""
    return near_dup.near_duplicates(load(spark, sf_dir, "documents"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of every vector whose id is divisible by 50."""
    vectors = load(spark, sf_dir, "embeddings")
    found = kmeans_tree.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document: pieces, hash of the ids, log-probability, log inclusion, and what
    they decode to."""
    samples = subword_sampling.sample_segmentations(load(spark, sf_dir, "documents"), k=2)
    return samples.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "log_inclusion",
                          "decoded_crc32")


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, by source, in every order and step."""
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every vector, and how many others it is linked with."""
    return pivot_index.near_vectors(load(spark, sf_dir, "embeddings"))


def frequent_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return collocations.collocations(load(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


_RUNS = {
    "op1_url_templates": url_filters,
    "op2_host_rules": host_rules,
    "op3_best_fit_packing": best_fit,
    "op4_hypergeometric_shards": uniform_shards,
    "op5_line_windows": repeated_lines,
    "op6_compression_toxicity": toxic_texts,
    "op7_trigram_secrets": secrets,
    "op8_lsh_forest": near_duplicates,
    "op9_kmeans_tree": nearest_vectors,
    "op10_gumbel_segmentations": sampled_pieces,
    "op11_filter_audit": filter_interactions,
    "op12_pivot_index": near_vectors,
    "op13_collocations": frequent_collocations,
}
QUERIES = {name: (run, SQL.get(name)) for name, run in _RUNS.items()}
