"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into
windows of ``WINDOW_WORDS`` words; what a window's compressed length gains under the toxic dictionary
over the ordinary one is its distance. Thresholds on the distances give a few numbers per document,
and a logistic curve over them, fitted to labelled rows, the score.

The dictionaries share a base trained on ordinary windows, so that common text compresses alike under
both, and end in a tail of equal size: trained on the words that recur in toxic documents and are clearly
rarer in ordinary ones, or on more ordinary text. Near copies are left out of training, or a copied passage would
pass for a trait. Each window is padded, since zstandard looks for no match in the last bytes. The
curve is fitted to distances under dictionaries trained on the other folds of the sample.

Training takes a bounded sample of the labelled rows: at most ``SAMPLE_TOXIC`` toxic and
``SAMPLE_ORDINARY`` ordinary ones of at most ``SAMPLE_CHARS`` characters, by hash of the id. Only ids
that ``may_learn`` allows are used. Only the text enters a score. Every whole text is scored, in one
pass without a shuffle; the model (some 70 KB) goes with the task.

Defined results: null, empty and wordless texts get the score of a document without any distance;
contradictory labels of one id are not learned from; without enough labels of both kinds every score
is the share of toxic labels, or 0; repeated rows are scored alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkscrub.llm.common import arrow_map, texts_of

WINDOW_WORDS = 8
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 1500, 4500, 50_000
BASE_BYTES, TAIL_BYTES = 32_768, 2048
LEAST_DOCS = 8
FOLDS = 3
DECIDE_AT = 0.7

_TOKEN = re.compile(r"\w+")
_PAD = bytes(range(1, 17))
_ZSTD = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 3, "min_match": 6, "strategy": zstandard.STRATEGY_GREEDY,
         "write_content_size": False, "write_checksum": False, "write_dict_id": False}


def windows(text: str | None) -> list[bytes]:
    words = _TOKEN.findall((text or "").lower())
    return [f" {' '.join(words[i:i + WINDOW_WORDS])} ".encode("utf-8", "replace") + _PAD for i in range(0, len(words), WINDOW_WORDS)]


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary's content; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _without_near_copies(texts: list[str]) -> list[str]:
    seen: set[bytes] = set()
    kept = []
    for text in texts:
        own = {w for w in windows(text) if len(w) > 46}
        if seen.isdisjoint(own):
            seen |= own
            kept.append(text)
    return kept


@dataclass(frozen=True)
class Dictionaries:
    toxic: bytes
    ordinary: bytes

    def distances(self):
        """A function from a window to its gain in bytes under the toxic dictionary."""
        settings = zstandard.ZstdCompressionParameters(**_ZSTD)
        made = []
        for content in (self.ordinary, self.toxic):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=settings)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress)
        ordinary, toxic = made
        return lambda window: len(ordinary(window)) - len(toxic(window))


def train_dictionaries(toxic: list[str], ordinary: list[str], seed: int = 6) -> Dictionaries:
    toxic, ordinary = _without_near_copies(toxic), _without_near_copies(ordinary)
    vocabulary = [[sorted(set(_TOKEN.findall(t.lower()))) for t in texts] for texts in (toxic, ordinary)]
    seen_in = [Counter(w for words in docs for w in words) for docs in vocabulary]
    n = [max(1, len(docs)) for docs in vocabulary]

    def typical(word: str) -> bool:
        a, b = seen_in[0][word], seen_in[1][word]
        p = (a + b) / (n[0] + n[1])
        return a >= 4 and a / n[0] - b / n[1] > 5 * (p * (1 - p) * (1 / n[0] + 1 / n[1])) ** 0.5

    chosen = {w for w in seen_in[0] if typical(w)}
    tail_samples = [f" {'  '.join(own)} ".encode("utf-8", "replace") for own in ([w for w in words if w in chosen] for words in vocabulary[0]) if own]
    plain = [w[:-len(_PAD)] for t in ordinary for w in windows(t)]
    order = np.random.default_rng(seed).permutation(len(plain))[:40_000]
    plain = [plain[i] for i in order]
    tail = train(tail_samples, TAIL_BYTES) if tail_samples else b""
    base = train(plain, BASE_BYTES)
    return Dictionaries(base + tail, base + (train(plain, len(tail)) if tail else b""))


def features(distances: list[int]) -> list[float]:
    """Sums and counts of the distances beyond thresholds, by length and as such."""
    if not distances:
        return [0.0] * 6
    x = np.array(distances, float)
    n = len(x)
    strong = x[x >= 3].sum()
    return [(x[x >= 2].sum() / n) ** 0.5, (strong / n) ** 0.5, np.log1p(strong), np.log1p((x >= 4).sum()), float(np.sort(x)[-2:].mean()), np.log(n)]


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries | None
    weights: tuple[float, ...]  # bias, then one per feature
    mean: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()

    def scorer(self):
        """A function from a text to its score."""
        if self.dictionaries is None:
            return lambda text: self.weights[0]
        distance = self.dictionaries.distances()
        mean, spread, bias, weights = np.array(self.mean), np.array(self.spread), self.weights[0], np.array(self.weights[1:])

        def score(text: str | None) -> float:
            z = bias + weights @ ((np.array(features([distance(w) for w in windows(text)])) - mean) / spread)
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias first) by Newton steps on the penalised likelihood."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries on all, the curve on what each fold gets from the other folds' dictionaries."""
    if min(len(toxic), len(ordinary)) < LEAST_DOCS:
        total = len(toxic) + len(ordinary)
        return Model(None, (len(toxic) / total if total else 0.0,))
    x, y = [], []
    for fold in range(FOLDS):
        others = ([t for i, t in enumerate(texts) if i % FOLDS != fold] for texts in (toxic, ordinary))
        distance = train_dictionaries(*others).distances()
        for label, texts in ((1, toxic[fold::FOLDS]), (0, ordinary[fold::FOLDS])):
            x += [features([distance(w) for w in windows(t)]) for t in texts]
            y += [label] * len(texts)
    x, y = np.array(x), np.array(y, float)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _logistic((x - mean) / spread, y)
    return Model(train_dictionaries(toxic, ordinary), tuple(weights), tuple(mean), tuple(spread))


def is_held_out(id_column: Column) -> Column:
    """Ids whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(3)) == 1


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from a bounded sample of the labelled documents that ``may_learn`` allows."""
    one = (labels.where(may_learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
           .agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    drawn = []
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        ids = one.where(F.col("label") == label).select("id").orderBy(F.xxhash64("id"), "id").limit(most)  # bounded, hence broadcast
        rows = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text")).collect()
        drawn.append([r["text"] for r in sorted(rows, key=lambda r: r["id"])])
    return fit(*drawn)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text."""
    held: list = []  # the compressors are made once a task

    def batch(ids, texts):
        if not held:
            held.append(model.scorer())
        return {"doc_id": ids, "score": [held[0](t) for t in texts]}

    return arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col)), "doc_id long, score double", batch)


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as struct ``row`` and their ``toxicity``."""
    at = docs.columns.index(text_col)
    shape = StructType([StructField("row", docs.schema), StructField("toxicity", DoubleType())])

    def run(batches):
        score = model.scorer()
        for batch in batches:
            rows = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            scores = pa.array([score(t) for t in texts_of(batch.column(at))], pa.float64())
            yield pa.RecordBatch.from_arrays([rows, scores], names=["row", "toxicity"])

    return docs.mapInArrow(run, shape)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; held-out labels are never read."""
    model = learn(docs, labels, ~is_held_out(F.col("doc_id")))
    return score_documents(docs, model).select(
        "doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= DECIDE_AT).cast("int").alias("predicted"))
