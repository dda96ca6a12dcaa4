"""Audit of how filters interact: which filter removes what, in every order in which they can run.

Five filters fail a document: A, fewer than 200 words; B, fewer than half of the words distinct; C, more
than one in fifty characters in ``[A-Z]``; D, a character of ``[#$%&*|]``; E, a text that a smaller
``doc_id`` has, anywhere in the table. A to D come from one pass over the text. E is an existential
self-join: a left-semi join on the text's hash, the exact text and a smaller id. The ids that E marks are
united with those that fail A to D, the bits of an id are put together, and documents are counted by
part and combination of bits. All that is told of the 120 orders is computed from these counts, at most
32 a part and label.

Scale: texts are moved for E only, and only those whose hash has a smaller id, which a bounded filter
(``hash_filter``) tells in the second scan; the right side of the semi join is one row per text,
combined map-side, and written, so that AQE can split the left side where a third of all rows are one
text. The work is in proportion to the rows; no pair of copies is ever made.

Defined results: a null text is empty and equals other empty ones; a null part is the empty string; a
null id never fails E and makes no other fail it; rows that are equal in id and text are each counted,
and neither makes the other fail; a document with several label rows is good or toxic if one of
them says so, labels of a null id belong to nothing; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, functions as F

from sparkscrub.llm.common import WORD_JAVA, shared
from sparkscrub.operators import hash_filter

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
_COPY = 1 << FILTERS.index("E")

_STEPS = [
    {"filter_order": "".join(order), "step": i + 1, "before": sum(1 << FILTERS.index(x) for x in order[:i]), "own": 1 << FILTERS.index(name)}
    for order in itertools.permutations(FILTERS) for i, name in enumerate(order)
]


def text_bits(text: Column) -> Column:
    """Bits of the filters A to D that the text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD_JAVA), 0)
    n = F.size(words)
    fails = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > CAPITAL_PERCENT * F.length(text),
        F.regexp_like(text, F.lit(SYMBOLS)),
    ]
    bits = F.lit(0)
    for i, failed in enumerate(fails):
        bits = bits + F.when(failed, 1 << i).otherwise(0)
    return bits


def copies_of_smaller(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, hash) of the rows of ``texts`` (id, hash, text) of which a smaller id has the text."""
    least = shared(keys.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("hash"), "audit-repeated")
    moved = hash_filter.prune(texts, "hash", hash_filter.build(least, "hash"))
    first = shared(moved.groupBy("hash", "text").agg(F.min("id").alias("first")).where("first IS NOT NULL"), "audit-first")
    right = first.select(F.col("hash").alias("other_hash"), F.col("text").alias("other_text"), "first").hint("merge")
    same = (F.col("hash") == F.col("other_hash")) & (F.col("text") == F.col("other_text")) & (F.col("first") < F.col("id"))
    return moved.join(right, same, "left_semi").select("id", "hash")


def bit_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, bits, n, good, toxic): documents by the combination of filters they fail."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"),
                        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    # rows of one id and hash fail alike: they are counted before anything is joined
    rows = shared(texts.select("id", "hash", "part", text_bits(F.col("text")).alias("bits"))
                  .groupBy("id", "hash", "part").agg(F.max("bits").alias("bits"), F.count(F.lit(1)).alias("n")), "audit-rows")
    copies = copies_of_smaller(texts.select("id", "hash", "text"), rows.select("id", "hash"))
    united = rows.where("bits > 0").select("id", "hash", "bits").unionByName(copies.withColumn("bits", F.lit(_COPY)))
    failing = shared(united.groupBy("id", "hash").agg(F.bit_or("bits").alias("failed")), "audit-failing")
    told = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id"))
            .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    failing = failing.select(F.col("id").alias("failing_id"), F.col("hash").alias("failing_hash"), "failed")
    joined = rows.select("id", "hash", "part", "n").join(
        failing.hint("merge"), F.col("id").eqNullSafe(F.col("failing_id")) & (F.col("hash") == F.col("failing_hash")), "left").join(
        told.hint("merge"), F.col("id") == F.col("label_id"), "left")
    return joined.groupBy("part", F.coalesce("failed", F.lit(0)).alias("bits")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does there."""
    counts = bit_counts(docs, labels, id_col, text_col, part_col)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))  # at most 32 a part
    steps = F.from_json(F.lit(json.dumps(_STEPS)), "array<struct<filter_order: string, step: int, before: int, own: int>>")
    each = parts.select("part", "c", F.explode(steps).alias("s"))

    def total(column, when, weight=None):
        value = (lambda x: x[column] * weight(x)) if weight else (lambda x: x[column])
        return F.aggregate("c", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.when(when(x["bits"]), value(x)).otherwise(0))

    own, before = F.col("s.own"), F.col("s.before")

    def fails(bits):
        return bits.bitwiseAND(own) != 0

    def here(bits):
        return fails(bits) & (bits.bitwiseAND(before) == 0)

    # of the orders of m failing filters one m-th begins with a given one
    orders = len(_STEPS) // len(FILTERS)
    return each.select(
        "part", "s.filter_order", "s.step",
        total("n", lambda bits: bits.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda bits: fails(bits) & (bits.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda bits: bits == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("n", fails, lambda x: (F.lit(orders) / F.bit_count(x["bits"])).cast("long")).alias("shapley"))
