"""Removal of repeated passages by overlapping windows of three lines.

A text is cut at line feeds; three consecutive lines form a window, which is hashed to 128 bits. A
window that occurs more than once in the whole table is kept where it occurs first, in the order of
document id and line; every later occurrence is covered, and the covered lines of a document,
merged, are taken out. Windows without any word are left alone, so blank lines stay.

Scale: only hashes and places are shuffled. First occurrences and counts are combined map-side, so
a window found in a third of all documents is one row per task. The repeated windows are written
and joined back to all windows with plain exchanges on both sides, which AQE splits where a window is
hot. What returns to a document is the list of its covered windows, no longer than its lines. The
text itself is dealt once, for that last join, alike at every size.

Defined results: a null text stays null; a text with fewer than three lines has no window and stays
as it is; a document whose lines are all covered gets an empty text; rows equal in
id and text are one document and treated alike; different texts of one id come in the order of a
hash; a null id sorts last; an empty table gives an empty result. The row is carried as one
struct, so no column name can clash.

The main path is DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkscrub.llm.common import WORD_JAVA, shared

WINDOW = 3


def _windows(lines: Column) -> Column:
    """(at, high, low) of every window that holds a word; the hash is of the lines and their borders."""
    places = F.when(F.size(lines) >= WINDOW, F.sequence(F.lit(0), F.size(lines) - WINDOW))
    texts = F.transform(places, lambda k: F.array_join(F.slice(lines, k + 1, F.lit(WINDOW)), "\n"))
    hashed = F.transform(texts, lambda t, k: F.struct(
        k.alias("at"), F.xxhash64(t).alias("high"), F.xxhash64(F.lit(WINDOW), t).alias("low"),
        F.regexp_like(t, F.lit(WORD_JAVA)).alias("worded")))
    return F.filter(hashed, lambda w: w["worded"])


def _kept_lines(lines: Column, covered: Column) -> Column:
    """The lines that no covered window holds: the gaps between windows that do not touch."""
    def gap(i):
        start = F.when(i == 0, 0).otherwise(F.get(covered, i - 1) + WINDOW)
        end = F.when(i == F.size(covered), F.size(lines)).otherwise(F.get(covered, i))
        return F.struct(start.alias("start"), F.greatest(end - start, F.lit(0)).alias("length"))

    gaps = F.filter(F.transform(F.sequence(F.lit(0), F.size(covered)), gap), lambda g: g["length"] > 0)
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["start"] + 1, g["length"])))


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows as struct ``row``, with ``text`` (cleaned), ``n_lines`` and ``n_removed``."""
    # a document is known by the 128-bit hash of id and text
    cut = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.split(text_col, "\n", -1).alias("lines"),
        F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("k2"))
    each = cut.select("id", "k1", "k2", F.explode(_windows(F.col("lines"))).alias("w"))
    windows = shared(each.select("id", "k1", "k2", "w.at", "w.high", "w.low"), "lines-windows")
    order = F.struct(F.col("id").isNull(), "id", "k1", "k2", "at")
    found = windows.groupBy("high", "low").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first != last")
    repeated = shared(found.select("high", "low", "first"), "lines-repeated")
    later = windows.join(repeated, ["high", "low"]).where(order != F.col("first"))
    covered = shared(later.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("at")).alias("covered")), "lines-covered")
    # the same plan at every size: the texts are dealt by document, not the covered lines sent to all tasks
    joined = cut.drop("id", "lines").join(covered.hint("merge"), ["k1", "k2"], "left")
    was = F.col("row")[text_col]
    lines = F.split(was, "\n", -1)
    left = F.when(F.col("covered").isNotNull(), _kept_lines(lines, F.col("covered")))
    done = joined.select("row", F.col("covered"), left.alias("left"), was.alias("was"), F.coalesce(F.size(lines), F.lit(0)).alias("n"))
    return done.select(
        "row", F.when(F.col("covered").isNull(), F.col("was")).otherwise(F.array_join("left", "\n")).alias("text"),
        F.when(F.col("was").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_lines"),
        F.when(F.col("covered").isNull(), 0).otherwise(F.col("n") - F.size("left")).cast("long").alias("n_removed"))
