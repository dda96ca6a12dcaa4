"""Toxicity, nearest neighbours and sampled segmentations."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscrub.llm.common import cosines
from sparkscrub.llm import kmeans_tree, subword_sampling, toxicity

BAD = ["wretched", "scoundrel", "miserable", "villainous", "loathsome"]


def toy_texts(n, seed):
    rng = random.Random(seed)
    parts = ["the", "an", "er", "on", "ti", "re", "ha", "es", "or", "ing"]

    def word():
        return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))

    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(30, 120))]
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_toxicity(spark):
    rows = toy_texts(600, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1001, "")], "doc_id long, text string")
    # labels of held-out rows are turned round: learning from them would show
    labels = spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, _, y in rows] + [(None, 1), (5, None)],
                                   "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert len(held) > 150
    assert np.mean([p for y, p in held if y]) > 0.9 and np.mean([p for y, p in held if not y]) < 0.02
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert got[1000].score == got[1001].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_without_labels(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(edge_docs, none).collect()} == {0.0}
    assert toxicity.classify(no_docs, none).collect() == []
    model = toxicity.fit(*[[t for _, t, y in toy_texts(80, 1) if y == k] for k in (1, 0)])
    scored = toxicity.with_score(edge_docs, model)
    assert scored.count() == edge_docs.count() and scored.select("row.*").schema == edge_docs.schema


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_toxicity_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    rate = {r.toxic: r.p for r in rows}
    assert rate[1] > 0.5 and rate[0] < 0.01


def exact_nearest(ids, m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i, q in enumerate(ids):
        if q % 50 == 0:
            s = u @ u[i]
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
            yield int(q), {int(ids[j]) for j in order}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    m = (centres[rng.integers(40, size=6000)] + 0.6 * rng.normal(size=(6000, 16))).astype(np.float32).astype(float)
    ids = np.arange(6000)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = {}
    for r in kmeans_tree.nearest(frame, frame.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, want in exact_nearest(ids, m, 5):
        own = sorted(got[q])
        assert [a for a, _, _ in own] == [1, 2, 3, 4, 5] and all(x[2] >= y[2] for x, y in zip(own, own[1:]))
        for _, v, s in own:
            assert s == pytest.approx(float(m[q] @ m[v] / np.linalg.norm(m[q]) / np.linalg.norm(m[v])), abs=1e-12)
        hits, total = hits + len(want & {v for _, v, _ in own}), total + 5
    assert hits / total >= 0.9


def test_copies_ties_and_invalid_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 300)] + [(400, [2.0, 0.0]), (401, [0.0, 0.0]), (402, None), (403, [float("nan"), 1.0]), (404, [None, 1.0]),
                                                      (405, [float("inf"), 1.0]), (450, [0.0, 1.0]), (451, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, label string, score double")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in kmeans_tree.nearest(frame, frame.where("vec_id % 50 = 0")).collect())
    assert [x[:3] for x in got if x[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (0, 5, 5)]
    assert [x[2] for x in got if x[0] == 100] == [0, 1, 2, 3, 4] and [x[2] for x in got if x[0] == 400] == [0, 1, 2, 3, 4]
    assert {x[0] for x in got} == {0, 50, 100, 150, 200, 250, 400, 450}
    few = frame.where("vec_id IN (0, 450)")
    assert [(r.query_id, r.vec_id) for r in kmeans_tree.nearest(few, few).orderBy("query_id").collect()] == [(0, 450), (450, 0)]
    assert kmeans_tree.nearest(frame.where("false"), frame.where("false")).collect() == []


def nearest_by_hand(rows, k=5):
    """{query: [(vec_id, score)]} of (id, vector) rows, an id's best vector counting."""
    best = {}
    for q, x in rows:
        if q % 50 == 0:
            for (i, _), s in zip(rows, cosines(np.array(x), np.array([v for _, v in rows]))):
                if i != q:
                    best.setdefault(q, {})[i] = max(float(s), best.get(q, {}).get(i, -2.0))
    return {q: sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k] for q, own in best.items()}


def test_scaled_copies_repeated_ids_and_huge_components(spark):
    rng = np.random.default_rng(8)
    base = np.array([1.0, 2.0, 3.0, 4.0])
    rows = [(50, base), *[(960 + i, base * (1 + 0.37 * i)) for i in range(40)], (900, base * 2), (901, base * 4), (899, base * 8)]
    rows += [(100, rng.normal(size=4)), (100, rng.normal(size=4)), (163, rng.normal(size=4)), (163, rng.normal(size=4)), (50, rng.normal(size=4))]
    rows += [(200, base * 1e200), (201, base * 1e-200), (202, base[::-1] * 1e250), (250, base[::-1] * 3e-310)]
    rows += [(300 + i, rng.normal(size=4)) for i in range(30)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in kmeans_tree.nearest(frame, frame.where("vec_id % 50 = 0"), target=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == nearest_by_hand(rows)


def test_chunks_and_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 8)))], "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 50 = 0")
    want = sorted(map(tuple, kmeans_tree.nearest(frame, asked).collect()))
    monkeypatch.setattr(kmeans_tree, "CHUNK", 32)
    monkeypatch.setattr(kmeans_tree, "BLOCK", 3)
    assert sorted(map(tuple, kmeans_tree.nearest(frame, asked).collect())) == want


@pytest.fixture(scope="module")
def arena():
    return subword_sampling.Arena(subword_sampling.vocabulary(subword_sampling.read_model(subword_sampling.TOKENIZER), 0.3))


needs_vocabulary = pytest.mark.skipif(not os.path.exists(subword_sampling.TOKENIZER), reason="no vocabulary file")


def all_segmentations(vocab, text):
    """{ids: probability} by listing every one."""
    weight = {p: (i, vocab.log_weight[i]) for i, p in enumerate(vocab.pieces) if vocab.log_weight[i]}
    text = subword_sampling.BLANK + text.replace(" ", subword_sampling.BLANK)

    def go(i):
        if i == len(text):
            yield (), 0.0
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in weight:
                for rest, w in go(j):
                    yield (weight[text[i:j]][0], *rest), weight[text[i:j]][1] + w

    found = dict(go(0))
    total = sum(map(math.exp, found.values()))
    return {s: math.exp(w) / total for s, w in found.items()}


@needs_vocabulary
def test_samples_follow_the_distribution_without_replacement(arena):
    text = "a then b"
    p = all_segmentations(arena.vocab, text)
    n = 5000
    first, pairs, included = Counter(), Counter(), Counter()
    for key in range(n):
        rows = subword_sampling.sample_texts(arena, [key], [text], 2, 1)[0]
        a, b = (tuple(int(x) for x in r[0]) for r in rows)
        assert a != b and rows[0][2] >= rows[1][2]
        assert rows[0][1] == pytest.approx(math.log(p[a])) and rows[1][1] == pytest.approx(math.log(p[b]))
        first[a] += 1
        pairs[a, b] += 1
        for s, r in ((a, rows[0]), (b, rows[1])):
            included[s] += 1 / math.exp(r[3])  # Horvitz-Thompson: 1 / inclusion has mean 1
    for s, q in sorted(p.items(), key=lambda x: -x[1])[:6]:
        assert first[s] / n == pytest.approx(q, abs=4 * math.sqrt(q / n))
        assert included[s] / n == pytest.approx(1, abs=4 / math.sqrt(n * q))  # rare ones have large weights
    for (a, b), c in pairs.most_common(6):
        q = p[a] * p[b] / (1 - p[a])
        assert c / n == pytest.approx(q, abs=4 * math.sqrt(q / n))


@needs_vocabulary
def test_search_lists_all_of_a_small_lattice(arena):
    p = all_segmentations(arena.vocab, "the")
    rows = subword_sampling.sample_texts(arena, [7], ["the"], 1000, 1)[0]
    assert {tuple(int(x) for x in r[0]) for r in rows} == set(p) and {r[3] for r in rows} == {0.0}


@needs_vocabulary
def test_samples_of_a_table(spark, edge_docs, edge_rows, no_docs):
    got = subword_sampling.decode(subword_sampling.sample_segmentations(edge_docs, k=3)).collect()
    texts = {i: t or "" for i, t, _ in edge_rows}
    assert all(r.decoded == texts[r.doc_id] for r in got)
    assert Counter(r.doc_id for r in got)[6] == 3 and Counter(r.doc_id for r in got)[4] == 1 and Counter(r.doc_id for r in got)[2] == 6
    assert len({tuple(r.ids) for r in got if r.doc_id == 1}) == 3
    again = subword_sampling.sample_segmentations(edge_docs.repartition(5).orderBy("text"), k=3)
    assert sorted((r.doc_id or 0, r.sample, r.ids) for r in again.collect()) == sorted((r.doc_id or 0, r.sample, r.ids) for r in got)
    assert subword_sampling.sample_segmentations(no_docs).collect() == []


@needs_vocabulary
def test_bytes_that_are_no_text_come_back(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61ff20c3a9edb0806280' AS STRING) AS text UNION ALL SELECT 2L, 'plain\n\u00e9'")
    got = subword_sampling.decode(subword_sampling.sample_segmentations(docs, k=2)).selectExpr("doc_id", "hex(decoded) AS h").collect()
    assert {(r.doc_id, r.h) for r in got} == {(1, "61FF20C3A9EDB0806280"), (2, "plain\né".encode().hex().upper())} and len(got) == 4


@needs_vocabulary
def test_full_arena_starts_anew(arena, monkeypatch):
    texts = [f"some words {i} here\nand🙂there" for i in range(30)]
    want = [[r[0].tolist() for r in rows] for rows in subword_sampling.sample_texts(arena, list(range(30)), texts, 2, 4)]
    monkeypatch.setattr(subword_sampling, "MOST_ARCS", 10)
    for i, t in enumerate(texts):
        assert [r[0].tolist() for r in subword_sampling.sample_texts(arena, [i], [t], 2, 4)[0]] == want[i]
        assert arena.vocab.decode(want[i][0]) == t.encode()


@needs_vocabulary
def test_checksums_of_many_sequences_at_once(arena):
    """Those of what each decodes to, empty sequences included."""
    vocab = arena.vocab
    some = [[], list(range(300, 340)), [], [vocab.byte_ids[0xE2], vocab.byte_ids[0x82], 500], [700]]
    ends = np.cumsum([0] + [len(x) for x in some])
    flat = np.array([i for x in some for i in x], np.int64)
    assert vocab.decoded_crc32(flat, ends) == [zlib.crc32(vocab.decode(x)) for x in some]
    assert vocab.decoded_crc32(flat[:0], np.zeros(3, np.int64)) == [0, 0]
