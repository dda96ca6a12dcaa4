"""Collocations against plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkscrub.llm import collocations
from sparkscrub.llm.sql import SQL

PIECE, WORD = re.compile(r"[^.,;:!?\x0A-\x0D]+"), re.compile(r"[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs, least, top=2000):
    """Rows of (text, lang) to {(lang, rank): (phrase, a, l, r, n, score)}."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in PIECE.findall((text or "").translate(LOWER)):
            words = WORD.findall(piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f.update((lang, tuple(words[i:i + size])) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {}
    for (lang, g), a in candidates.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                inside[lang, g[i:i + m]] = max(inside.get((lang, g[i:i + m]), 0), a)
    rows = {}
    for (lang, g), a in candidates.items():
        if 100 * inside.get((lang, g), 0) < 100 * a:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, i + 1): (p.decode(), -a, l, r, n[lang], -score) for lang, found in rows.items() for i, (score, a, p, l, r) in enumerate(sorted(found)[:top])}


def found(frame, **options):
    got = collocations.collocations(frame, **options).collect()
    table = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got}
    assert len(table) == len(got)
    return table


def random_docs(seed, rows=80):
    rng = random.Random(seed)
    words = ["a", "A", "b", "ß", "é", "漢字", "no-one", " ", "\x00z", "i'm", "x."]
    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", "\n", ".", "  "]) for _ in range(rng.randrange(60)))
    docs = [(text(), rng.choice(["en", "de", None])) for _ in range(rows)]
    return docs + [(None, "en"), ("", "fr"), (" \t\v", None), (docs[0][0], docs[0][1])] + [("same words again and again", "en")] * 40


@pytest.mark.parametrize("flush_words", [50, 2_000_000])
def test_collocations_on_random_texts(spark, flush_words):
    docs = random_docs(5)
    frame = spark.createDataFrame([(t, x, 1, "p") for t, x in docs], "text string, lang string, size int, phrase string")
    assert found(frame, least=12, flush_words=flush_words) == by_hand(docs, 12)
    assert found(frame, least=12, top=3, flush_words=flush_words) == by_hand(docs, 12, 3)


def test_fingerprints_that_collide(spark, monkeypatch):
    """With four fingerprints only, counts still are those of the phrases."""
    plain = collocations.fingerprints
    monkeypatch.setattr(collocations, "fingerprints", lambda *a: plain(*a) % np.uint64(4))
    rng = np.random.default_rng(0)
    numbers = rng.integers(-1, 4, 500).astype(np.int32)
    hashes = np.append(np.arange(1, 5, dtype=np.uint64), np.uint64(0))
    prints, counts, places = collocations.count_grams(numbers, collocations.prefix_polynomials(hashes[numbers]), 2)
    want = Counter(tuple(numbers[i:i + 2].tolist()) for i in range(499) if (numbers[i:i + 2] >= 0).all())
    assert {tuple(numbers[p:p + 2].tolist()): c for p, c in zip(places.tolist(), counts.tolist())} == want
    assert len(prints) == len(want) and set(prints.tolist()) <= set(range(4))


def test_many_collisions_change_no_count(spark):
    """Word hashes of five bits only: most fingerprints stand for several phrases."""
    docs = random_docs(7)
    frame = spark.createDataFrame(docs, "text string, lang string")

    def short(word):
        return sum(word) % 32

    plain, collocations.word_hash = collocations.word_hash, short
    try:
        texts = frame.selectExpr("coalesce(lang, 'und') AS lang", "xxhash64(coalesce(text, '')) AS text_hash", "coalesce(text, '') AS text")
        flush = collocations._Flush()
        for r in texts.collect():
            flush.add(r.lang, r.text_hash, r.text.encode())
        counts = Counter()
        for batch in flush.rows((1, 2, 3), 0, None):
            for r in batch.to_pylist():
                counts[r["lang"], r["size"]] += r["count"]
                assert r["count"] > 0
    finally:
        collocations.word_hash = plain
    want = Counter()
    for text, lang in docs:
        for piece in PIECE.findall((text or "").translate(LOWER)):
            for size in (1, 2, 3):
                want[lang or "und", size] += max(0, len(WORD.findall(piece)) - size + 1)
    assert counts == +want


def test_prints_do_not_depend_on_the_place():
    hashes = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    x = collocations.fingerprints(collocations.prefix_polynomials(hashes), 3)
    assert x[0] == x[3] and len(set(x.tolist())) == 4


def test_collocations_on_edges(spark, edge_docs, edge_rows, no_docs):
    docs = [(t, "en") for _, t, _ in edge_rows]
    assert found(edge_docs, least=2) == by_hand(docs, 2)
    assert found(no_docs) == {}
    assert found(edge_docs, least=10**6) == {}


def test_sql_of_collocations(spark):
    docs = [(t, x) for t, x in random_docs(6, 60) for _ in range(12)]
    frame = spark.createDataFrame(docs, "text string, lang string")
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = {(r[0], r[1]): tuple(r[2:]) for r in con.execute(SQL["op13_collocations"]).fetchall()}
    assert found(frame) == want == by_hand(docs, 100)


def test_texts_are_not_moved(spark):
    """What is counted goes by fingerprint alone; only phrases that may be frequent are spelt out, once for each flush."""
    docs = [("so it is said " * 5, "en")] * 30 + [(f"word{i} other{i} third{i}", "en") for i in range(200)]
    texts = spark.createDataFrame(docs, "text string, lang string")
    grams = collocations.partial_counts(texts.repartition(1), (1,))
    assert "text_hash" not in grams.columns and grams.where("phrase IS NOT NULL").count() == 0
    singles = collocations._filter_of_frequent(grams, 100)
    spelt = collocations.partial_counts(texts.repartition(1), (), spelt=[((1,), 0, None, singles), ((2,), 1, singles, np.full(1, 2**64 - 1, np.uint64))])
    got = Counter({bytes(r["phrase"]).decode(): r["count"] for r in spelt.collect()})
    assert {w: got[w] for w in ("so", "it", "is", "said", "so it", "said so")} == {"so": 150, "it": 150, "is": 150, "said": 150, "so it": 150, "said so": 120}
    assert len(got) < 20
