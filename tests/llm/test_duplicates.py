"""Line windows and near duplicates against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest

from sparkscrub.llm import line_dedup, near_dup
from sparkscrub.llm.sql import line_dedup_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cleaned_by_hand(docs):
    """{doc_id: text} in order of id; rows equal in id and text are one."""
    seen, out = set(), {}
    for i, text in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        if text is None:
            out[i] = None
            continue
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            w = "\n".join(lines[k:k + 3])
            if WORD.search(w):
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_windows_on_edges(spark, edge_docs, edge_rows, no_docs):
    got = line_dedup.remove_repeated_passages(edge_docs).collect()
    want = cleaned_by_hand([(i, t) for i, t, _ in edge_rows])
    assert len(got) == len(edge_rows)
    for r in got:
        assert r.text == want[r.row.doc_id]
        assert r.n_removed == (0 if r.text is None else r.n_lines - (len(r.text.split("\n")) if r.text or r.n_removed < r.n_lines else 0))
    assert line_dedup.remove_repeated_passages(no_docs).collect() == []


def test_line_windows_on_random_texts(spark):
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "", "d e"]) for _ in range(rng.randrange(12)))) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in line_dedup.remove_repeated_passages(frame).collect()}
    assert got == cleaned_by_hand(docs)
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    assert {i: t for i, _, _, t in con.execute(line_dedup_sql("documents")).fetchall()} == got


def test_main_path_has_no_python(spark, edge_docs):
    plan = line_dedup.remove_repeated_passages(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def groups_by_hand(docs):
    """{row: smallest id of its component}; docs are (id, text) with ids."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [least[root(i)] for i in range(len(docs))]


def varied(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_docs():
    rng = random.Random(3)
    docs = []
    for _ in range(40):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(3, 150))]
        docs += [varied(rng, base, rng.randrange(0, 5)) for _ in range(rng.randrange(1, 6))]
    base = [f"q{i}" for i in range(150)]
    docs += [varied(rng, base, rng.randrange(1, 5)) for _ in range(250)] + [" ".join(base).upper()] * 30
    rng.shuffle(docs)
    return list(enumerate(docs, 1))


def test_near_duplicates_against_all_pairs(spark, near_docs):
    got = near_dup.near_duplicates(spark.createDataFrame(near_docs, "doc_id long, text string")).collect()
    want = groups_by_hand(near_docs)
    assert {r.doc_id: r.component_id for r in got} == {i: c for (i, _), c in zip(near_docs, want)}
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in near_docs}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_divided_regions_lose_no_group(spark, near_docs, monkeypatch):
    monkeypatch.setattr(near_dup, "REGION_ROWS", 16)
    monkeypatch.setattr(near_dup, "ANCHORS", 8)
    got = near_dup.near_duplicates(spark.createDataFrame(near_docs, "doc_id long, text string")).collect()
    want = groups_by_hand(near_docs)
    assert np.mean([r.component_id == want[r.doc_id - 1] for r in got]) > 0.99


def test_near_duplicates_on_edges(spark, edge_docs, edge_rows, no_docs):
    got = near_dup.near_duplicates(edge_docs).collect()
    assert len(got) == len(edge_rows)
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[4, 0].component_id == 4 and by[3, 0].kept and by[5, 0].component_id == 5 and by[9, 0].kept
    assert sorted(r.doc_id for r in got if r.component_id == 1 and r.doc_id) == [1, 2, 2]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(1, False)]
    assert near_dup.near_duplicates(no_docs).collect() == []


def test_components_of_a_chain(spark):
    names = [i.to_bytes(2, "big") for i in range(200)]
    edges = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in zip(names, names[1:])], "a binary, b binary")
    assert near_dup.components(edges).select("component").distinct().count() == 1


def crowd_with_pairs():
    """Texts on one boilerplate (similarity 0.70, no link), 40 of which have a partner just above 0.75."""
    rng = random.Random(5)

    def fresh(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    base, docs = [f"b{i}" for i in range(204)], []
    for i in range(160):
        tail = fresh(43)
        docs.append(base + tail)
        if i < 40:
            docs.append(base + tail[:11] + fresh(32))
    rng.shuffle(docs)
    return [(i, " ".join(words)) for i, words in enumerate(docs, 1)]


def test_divided_regions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "REGION_ROWS", 4)
    monkeypatch.setattr(near_dup, "ANCHORS", 2)
    docs = crowd_with_pairs()
    want = groups_by_hand(docs)
    assert len(docs) - len(set(want)) == 40
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for (i, _), c in zip(docs, want)}
