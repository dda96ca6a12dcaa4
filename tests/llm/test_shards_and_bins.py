"""Sharding and packing: laws, margins, conflicts."""

from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from sparkscrub.llm import packing, sharding


def test_matrix_margins():
    sizes, shards = [5, 0, 17, 100, 3], sharding.shard_sizes(125, 7)
    m = sharding.communication_matrix(sizes, shards, 1)
    assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == shards
    assert sharding.communication_matrix([], [0, 0], 1).shape == (0, 2)


def test_matrix_is_hypergeometric():
    draws = np.array([sharding.communication_matrix([6, 4], [5, 5], s)[0, 0] for s in range(4000)])
    want = {k: v / 252 for k, v in zip(range(1, 6), (6 * 1, 15 * 4, 20 * 6, 15 * 4, 6))}  # C(6,k) C(4,5-k) / C(10,5)
    for k, p in want.items():
        assert abs((draws == k).mean() - p) < 0.03


def test_large_populations():
    rng = np.random.default_rng(0)
    x = [sharding.hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(20)]
    assert abs(np.mean(x) - 750_000) < 500
    assert sharding.hypergeometric(rng, 2 * 10**9, 0, 5) == 5


def test_shards(spark, edge_docs, no_docs):
    got = sharding.shuffle_to_shards(edge_docs, 4).collect()
    assert Counter(map(str, (r.row for r in got))) == Counter(map(str, edge_docs.collect()))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shuffle_to_shards(no_docs, 4).collect() == []
    assert sorted((r.shard, r.slot) for r in sharding.shuffle_to_shards(edge_docs.limit(2), 4).collect()) == [(0, 0), (1, 0)]


def test_ranges_give_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    got = sharding.shuffle_to_shards(spark.range(0, 1000, 1, 7), 3).collect()
    for shard in range(3):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    # a uniform shuffle: neighbours land anywhere
    of = {r.row.id: r.shard for r in got}
    assert 0.25 < np.mean([of[i] == of[i + 1] for i in range(999)]) < 0.42


def test_written_shards(spark, tmp_path):
    sharding.write_shards(sharding.shuffle_to_shards(spark.range(50), 3), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and set(back.columns) == {"slot", "id", "shard"}


def check_bins(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        if r.bin is not None:
            bins[r.bin].append(r)
    for parts in bins.values():
        assert sum(r.n_words for r in parts) <= capacity
        assert len({r.source for r in parts}) == len(parts)
        assert len({r.cluster for r in parts}) == len(parts)
        place = 0
        for r in sorted(parts, key=lambda r: r.bin_offset):
            assert r.bin_offset == place
            place += r.n_words
    return bins


def test_packing(spark, edge_docs, edge_rows, no_docs):
    rows = packing.pack(edge_docs, 100).collect()
    check_bins(rows, 100)
    words = Counter()
    for r in rows:
        words[r.doc_id] += r.n_words
    want = Counter()
    for i, t, _ in edge_rows:
        want[i] += len((t or "").split())  # no unusual blanks inside these words
    assert words[6] == 30_000 and words[1] == want[1] and words[2] == want[2]
    assert all((r.bin is None) == (r.n_words == 0) for r in rows)
    assert packing.pack(no_docs, 100).collect() == []


@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(0, 5)), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_takes_the_tightest_compatible_bin(items):
    fit, bins = packing.BestFit(20), []
    for size, source, cluster in items:
        open_bins = [(20 - sum(x[0] for x in b), k) for k, b in enumerate(bins)
                     if sum(x[0] for x in b) + size <= 20 and all(x[1] != source and x[2] != cluster for x in b)]
        got = fit.place(size, source, cluster)
        if not open_bins:
            assert got == len(bins)
            bins.append([])
        else:
            assert 20 - sum(x[0] for x in bins[got]) == min(open_bins)[0] and any(k == got for _, k in open_bins)
        bins[got].append((size, source, cluster))


def test_bin_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (2, "f g", "y"), (3, None, "z")], "doc_id long, text string, source string")
    texts = packing.bin_texts(docs, packing.pack(docs, 4)).collect()
    assert Counter(" ".join(r.text for r in texts).split()) == Counter("abcdefg")
    assert all(len(r.text.split()) <= 4 for r in texts)
