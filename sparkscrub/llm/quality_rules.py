"""Host-level quality rules.

Every document is judged by a few base rules on its words and lines. The failures are then added up
by host (here: source), the host's failure rate is shrunk towards the rates of all hosts with an
empirical beta prior, and a host whose shrunk rate is too high takes all its documents with it.

The counts of a document are made in one pass over the text and written once, 50 bytes a document:
they are needed for the host rates and again for the verdicts. Host sums are combined map-side, so a
host with a third of all rows is one row per task in the shuffle. The prior comes from three sums
over the host table. Only rejected hosts are joined back; the join is left to Spark's size checks and
to AQE's splitting of skewed partitions (both sides are read from written tables).

Defined results: a null text counts as an empty one (and fails: fewer than ten words); documents
without a host form a host of their own; repeated rows are judged one by one; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sparkscrub.llm.common import WORD, arrow_map, shared

SYMBOLS = "#*$%&|<>"
_DROP_SYMBOLS = str.maketrans("", "", SYMBOLS)


@dataclass(frozen=True)
class HostPolicy:
    """When a host is rejected: its shrunk failure rate reaches ``max_rate``, and that is no accident
    of few documents: the rate less ``z`` posterior deviations still reaches ``sure_rate``."""

    max_rate: float = 0.6
    sure_rate: float = 0.5
    z: float = 2.0


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated five-word windows."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD.findall(text)
    symbols = len(text) - len(text.translate(_DROP_SYMBOLS))
    lines = [line for line in text.split("\n") if WORD.search(line)] if "\n" in text else []
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[str], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that occurs at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i:i + n] |= hit
    return int(covered.sum())


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Id, host, the five counts and whether a base rule fails, for every document."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def batch(ids, texts, hosts):
        columns = list(zip(*map(text_counts, texts)))
        return {"doc_id": ids, "host": hosts} | dict(zip(names, columns))

    schema = "doc_id long, host string, " + ", ".join(f"{n} long" for n in names)
    rows = arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col), F.col(host_col).cast("string")), schema, batch)
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_verdicts(judged: DataFrame, policy: HostPolicy = HostPolicy()) -> DataFrame:
    """Host, documents, failures, shrunk rate, its posterior deviation, and whether the host is rejected.

    The prior beta(a, b) matches the mean and variance of the host rates. The variance that mere
    sampling adds is taken off first; hosts that then hardly differ give a strong prior.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = (
        hosts.agg(F.sum("n").alias("sn"), F.sum("failed").alias("sf"), F.count(F.lit(1)).alias("h"),
                  F.avg(rate).alias("m0"), F.var_samp(rate).alias("v0"), F.avg(1 / F.col("n")).alias("inv"))
        # the mean of all documents, kept off 0 and 1
        .withColumn("mean", (F.col("sf") + 0.5) / (F.col("sn") + 1.0))
        .withColumn("bin", F.col("mean") * (1 - F.col("mean")))
        .withColumn("between", F.greatest(F.coalesce("v0", F.lit(0.0)) - F.col("bin") * F.col("inv"), F.col("bin") / 1000))
        .withColumn("strength", F.greatest(F.col("bin") / F.col("between") - 1, F.lit(1.0)))
        .select((F.col("mean") * F.col("strength")).alias("a"), ((1 - F.col("mean")) * F.col("strength")).alias("b"))
    )  # one row
    shrunk = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", (F.col("failed") + F.col("a")) / (F.col("n") + F.col("a") + F.col("b")))
    sd = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n") + F.col("a") + F.col("b") + 1))
    rejected = (F.col("host_rate") >= policy.max_rate) & (F.col("host_rate") - policy.z * sd >= policy.sure_rate)
    return shrunk.select("host", "n", "failed", "host_rate", sd.alias("host_rate_sd"), rejected.alias("host_rejected"))


def judge_documents(docs: DataFrame, policy: HostPolicy = HostPolicy(), id_col: str = "doc_id", text_col: str = "text",
                    host_col: str = "source") -> DataFrame:
    """All documents with their counts, ``base_failed`` and ``kept``: neither rule nor host speaks against it."""
    counts = shared(base_counts(docs, id_col, text_col, host_col), "quality-counts")
    hosts = host_verdicts(counts, policy)
    bad = shared(hosts.where("host_rejected").select("host"), "quality-hosts").withColumn("bad", F.lit(True))
    c = counts.alias("c")
    joined = c.join(bad.alias("b"), F.col("c.host").eqNullSafe(F.col("b.host")), "left")
    return joined.select("c.*", (~F.col("base_failed") & F.col("b.bad").isNull()).alias("kept"))
