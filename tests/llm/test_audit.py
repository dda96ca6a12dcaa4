"""The filter audit against a plain count over all orders."""

import itertools
import random
import re

import pytest

from sparkscrub.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """Each row's set of failed filters; rows are (id, text, part)."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = WORD.findall(t)
        f = {"A"} if len(words) < 200 else set()
        f |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        out.append(f)
    return out


def by_hand(rows, labels):
    failed = fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, removed_in_all = {}, {}
    for part in {p or "" for _, _, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, failed) if (p or "") == part]
        for order in itertools.permutations("ABCDE"):
            for k, name in enumerate(order):
                gone = [i for i, f in own if name in f and not f & set(order[:k])]
                removed_in_all[part, name] = removed_in_all.get((part, name), 0) + len(gone)
                out[part, "".join(order), k + 1] = (
                    sum(not f & set(order[:k + 1]) for _, f in own), len(gone),
                    sum(name in f and bool(f & set(order[:k])) for _, f in own), sum(f == {name} for _, f in own),
                    sum(i in good for i in gone), sum(i in toxic for i in gone))
    return {k: v + (removed_in_all[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def audited(spark, docs, labels):
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, told).collect()
    table = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(table) == len(got)
    return table


def test_audit_on_edges(spark, edge_docs, edge_rows, no_docs):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, None, None), (None, 1, 1), (99, 1, 1)]
    assert audited(spark, edge_docs, labels) == by_hand(edge_rows, labels)
    assert audited(spark, no_docs, labels) == {}
    assert audited(spark, edge_docs, []) == by_hand(edge_rows, [])


def test_audit_on_random_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Up", "low", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([3, 150, 260]))) + rng.choice(["", "#"]) for _ in range(25)]
    texts += ["é" * 300, "A" + "é" * 49, " ".join(f"x{i}" for i in range(200)), " ".join(f"x{i % 100}" for i in range(200))]
    rows = [(rng.randrange(60), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(150)]
    rows += [(500 + i, texts[0], "hot") for i in range(100)]
    labels = [(i, rng.choice([0, 1]), rng.choice([0, 1])) for i in range(0, 60, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert audited(spark, docs, labels) == by_hand(rows, labels)


def test_equal_hashes_do_not_join(spark):
    texts = spark.createDataFrame([(1, 7, "x"), (2, 7, "y"), (3, 7, "x"), (4, 8, "x")], "id long, hash long, text string")
    got = filter_audit.copies_of_smaller(texts, texts.select("id", "hash")).collect()
    assert [(r.id, r.hash) for r in got] == [(3, 7)]


@pytest.mark.parametrize("order", ["ABCDE", "EDCBA"])
def test_steps_add_up(spark, edge_docs, edge_rows, order):
    got = audited(spark, edge_docs, [])
    for part in {p or "" for _, _, p in edge_rows}:
        left = sum((p or "") == part for _, _, p in edge_rows)
        for step in range(1, 6):
            kept, removed = got[part, order, step][:2]
            assert kept == left - removed
            left = kept
