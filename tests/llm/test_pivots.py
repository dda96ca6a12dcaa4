"""The pivot-permutation index against all pairs."""

import duckdb
import numpy as np
import pytest

from sparkscrub.llm import pivot_index
from sparkscrub.llm.common import cosines
from sparkscrub.llm.sql import SQL

NAN, INF = float("nan"), float("inf")


def sound(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def links_by_hand(rows, least=0.95):
    """Pairs of places of (id, vector) rows, and their cosines."""
    out = {}
    at = [i for i, (_, v) in enumerate(rows) if sound(v)]
    for x, i in enumerate(at):
        for j in at[x + 1:]:
            if len(rows[i][1]) == len(rows[j][1]):
                c = cosines(np.array(rows[i][1], float), np.array([rows[j][1]], float))[0]
                if c >= least:
                    out[i, j] = c
    return out


def by_hand(rows):
    """Sorted (id, n_links, component_id, kept)."""
    root, count = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links_by_hand(rows):
        count[i] += 1
        count[j] += 1
        root[top(i)] = top(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[top(i)] = min(name, least.get(top(i), name))
    return sorted(((name, count[i], least.get(top(i)), name == least.get(top(i))) for i, (name, _) in enumerate(rows)), key=repr)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, label int, node string, n int")
    return sorted((tuple(r) for r in pivot_index.near_vectors(frame, **options).collect()), key=repr)


def moved(rng, row, cosine):
    away = rng.normal(size=row.shape)
    away -= away @ row * row
    return cosine * row + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)


def test_edges(spark):
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, base), (2, [2 * x for x in base]), (2, base), (2, base), (None, base), (3, None), (3, []), (4, [0.0] * 4), (5, [1.0, None, 0.0, 2.0]),
            (6, [1.0, NAN, 0.0, 2.0]), (7, [INF, 1.0, 1.0, 1.0]), (8, [1e200, 2e200, 3e200, 4e200]), (9, [1e-300, 2e-300, 3e-300, 4e-300]),
            (10, [-0.0, 1.0, 0.0, 0.0]), (11, [0.0, 1.0, -0.0, 0.0]), (12, [0.0, 1.0]), (13, [0.1, 1.0]), (14, [5.0]), (15, [-5.0]), (None, [9.0, -1.0, 0.0, 0.0]),
            (None, None), (16, [9.0, -1.0, 0.0, 0.1])]
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (None, [0.0])]) == by_hand([(1, None), (None, [0.0])])
    assert found(spark, [(7, base)]) == [(7, 0, 7, True)]


@pytest.mark.parametrize("block", [64, 1024])
def test_crowds(spark, block):
    """A crowd of near copies, equal copies, and vectors of their own: no link between them is lost."""
    rng = np.random.default_rng(2)
    own = rng.normal(size=(300, 32))
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    crowd = [moved(rng, own[0], 0.992) for _ in range(250)]
    rows = [(i, v.tolist()) for i, v in enumerate([*own, *crowd, *[own[1]] * 120, *[3 * x for x in own[2:40]]])]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    assert found(spark, rows, block=block) == by_hand(rows)


def test_recall_at_the_threshold(spark):
    """Pairs that hardly reach the threshold are found, nearly all; none below it."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 64))
    own = centres[rng.integers(8, size=2500)] * 0.6 + rng.normal(size=(2500, 64))
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    near = [moved(rng, x, c) for x, c in zip(own[:600], rng.uniform(0.945, 0.96, 600))]
    rows = [(i, v.tolist()) for i, v in enumerate([*own, *near])]
    truth = np.zeros(len(rows), int)
    for i, j in links_by_hand_fast(rows):
        truth[i] += 1
        truth[j] += 1
    got = {r[0]: r[1] for r in found(spark, rows)}
    assert all(got[i] <= truth[i] for i in range(len(rows)))
    assert sum(got.values()) >= 0.95 * truth.sum() > 600


def links_by_hand_fast(rows):
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return [(i, j) for i, j in zip(*np.nonzero(m @ m.T >= 0.95)) if i < j]


def test_all_in_one_direction(spark):
    """One pivot only: all meet in one list."""
    rng = np.random.default_rng(5)
    rows = [(i, moved(rng, np.eye(16)[0], rng.uniform(0.9, 0.99)).tolist()) for i in range(150)]
    assert found(spark, rows, block=32) == by_hand(rows)


def test_pivots_lie_apart():
    rng = np.random.default_rng(1)
    one = rng.normal(size=64)
    sample = pivot_index.units(np.vstack([one + 0.1 * rng.normal(size=(500, 64)), rng.normal(size=(300, 64))]))
    pivots = pivot_index.choose_pivots(sample)
    near = pivots.at @ pivots.at.T - np.eye(len(pivots.at))
    assert near.max() < pivot_index.APART and ((pivots.at @ pivot_index.units(one[None])[0]) > 0.9).sum() <= 1
    assert pivot_index.FEWEST <= pivots.take <= pivot_index.MOST


def test_sql_of_vectors(spark):
    rng = np.random.default_rng(6)
    own = rng.normal(size=(60, 16))
    rows = [(i % 70, v.tolist()) for i, v in enumerate([*own, *[moved(rng, own[0], 0.99) for _ in range(20)], np.zeros(16)])] + [(None, None), (5, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.register("embeddings", frame.toPandas())
    got = con.execute("SELECT vec_id, n_links, component_id, kept FROM (" + SQL["op12_pivot_index"] + ")").fetchall()
    assert sorted(got, key=repr) == by_hand(rows) == found(spark, rows)
