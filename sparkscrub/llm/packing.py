"""Conflict-constrained best-fit packing of documents into bins of fixed length.

A document of n words is cut into pieces of at most ``capacity`` words, and the pieces are packed
into bins by best fit, longest first: each piece goes to the tightest bin that it fits into, unless
the bin already holds its source or its cluster of copies; then the search goes on to the next larger
residual, until a compatible bin is found or a new one is opened.

Bins are ordered by residual: for each residual a bitmap of its open bins, and a bitmap of residuals
that have any. Each source and each cluster carries the bitmap of the bins that hold it, so one step
of the search is one AND over all bins of a residual.

Scale: only ids, lengths and hashes are packed, the text stays where it is. The pieces are dealt at
random over packing groups of about ``GROUP_ROWS`` pieces, whose number grows with the table; a
source with a third of all rows and a cluster of thousands are spread over all groups alike. Bins
never cross groups, so every conflict is seen. A piece of full length is a bin of its own and takes
no part in the search. The dealing hash is of the piece alone, so a repeated task gives the same bins.

Defined results: null and empty texts have no piece and are in no bin (``bin`` null, length 0); a null
source is a source of its own; repeated rows are pieces of the same cluster and never share a bin;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkscrub.llm.common import WORD_JAVA, random_key, shared

CAPACITY = 2048
GROUP_ROWS = 4000


class BestFit:
    """Open bins of one group, searched by residual and filtered by conflict bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residual: list[int] = []
        self.at: dict[int, int] = defaultdict(int)  # residual -> bitmap of bins
        self.residuals = 0  # bitmap of residuals with bins
        self.open = 0  # bitmap of bins with any room
        self.of_source: dict = defaultdict(int)
        self.of_cluster: dict = defaultdict(int)

    def place(self, size: int, source, cluster) -> int:
        free = self.open & ~(self.of_source[source] | self.of_cluster[cluster])
        chosen = None
        left = self.residuals >> size
        r = size
        while free and left:
            step = (left & -left).bit_length() - 1
            r, left = r + step, left >> step
            if hit := self.at[r] & free:
                chosen = (hit & -hit).bit_length() - 1
                break
            r, left = r + 1, left >> 1
        if chosen is None:
            chosen, r = len(self.residual), self.capacity
            self.residual.append(self.capacity)
        else:
            self._unlist(chosen, r)
        bit = 1 << chosen
        self.residual[chosen] = rest = r - size
        if rest:
            self.at[rest] |= bit
            self.residuals |= 1 << rest
            self.open |= bit
        self.of_source[source] |= bit
        self.of_cluster[cluster] |= bit
        return chosen

    def _unlist(self, number: int, r: int) -> None:
        bit = 1 << number
        self.at[r] ^= bit
        if not self.at[r]:
            self.residuals ^= 1 << r
        self.open &= ~bit


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """One row per piece: id, source, cluster, number, first word and length. A text without words gives length 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.md5(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       cluster.alias("cluster"), F.regexp_count(text, F.lit(WORD_JAVA)).alias("words"))
    last = F.greatest(F.expr(f"(words - 1) div {capacity}"), F.lit(0))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    start = F.col("piece") * capacity
    return rows.select("doc_id", "source", "cluster", F.col("piece").cast("int"), start.cast("long").alias("first_word"),
                       F.least(F.col("words") - start, F.lit(capacity)).cast("int").alias("n_words"))


def pack(docs: DataFrame, capacity: int = CAPACITY, seed: int = 5, **columns) -> DataFrame:
    """Every piece with ``bin`` (text, unique over all groups) and its place in the bin's sequence of words."""
    made = shared(pieces(docs, capacity, **columns).withColumn("rid", F.monotonically_increasing_id()), "pack-pieces")
    short = (F.col("n_words") > 0) & (F.col("n_words") < capacity)
    groups = max(1, -(-made.where(short).count() // GROUP_ROWS))
    dealt = made.where(short).withColumn("packing_group", F.pmod(random_key(seed, F.col("rid")), F.lit(groups)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "rid"], ascending=[False, True], kind="stable")
        bins = BestFit(capacity)
        number = [bins.place(int(n), s, c) for n, s, c in zip(pdf.n_words, pdf.source, pdf.cluster)]
        pdf = pdf.assign(number=number)
        offset = pdf.groupby("number").n_words.cumsum() - pdf.n_words
        return pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "cluster": pdf.cluster, "piece": pdf.piece,
                             "first_word": pdf.first_word, "n_words": pdf.n_words,
                             "bin": [f"g{g}-{k}" for g, k in zip(pdf.packing_group, number)], "bin_offset": offset})

    shape = "doc_id long, source string, cluster string, piece int, first_word long, n_words int, bin string, bin_offset int"
    packed = dealt.groupBy("packing_group").applyInPandas(fill, shape)
    full = made.where(~short).select(
        "doc_id", "source", "cluster", "piece", "first_word", "n_words",
        F.when(F.col("n_words") > 0, F.concat(F.lit("f"), F.col("rid").cast("string"))).alias("bin"),
        F.when(F.col("n_words") > 0, F.lit(0)).alias("bin_offset"))
    return packed.unionByName(full)


def bin_texts(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per bin with its pieces' words in order, joined by a blank. A bin holds at most ``capacity`` words.

    Ids must be unique here: a piece finds its text by id."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_JAVA), F.lit(0))
    texts = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    rows = packed.where("bin IS NOT NULL").join(texts, "doc_id").select(
        "bin", "bin_offset", "doc_id", F.array_join(F.slice("words", F.col("first_word").cast("int") + 1, F.col("n_words")), " ").alias("text"))
    ordered = F.sort_array(F.collect_list(F.struct("bin_offset", "doc_id", "text")))
    return rows.groupBy("bin").agg(ordered.alias("parts")).select(
        "bin", F.col("parts.doc_id").alias("doc_ids"), F.array_join("parts.text", " ").alias("text"))
