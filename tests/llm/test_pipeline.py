"""The stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from sparkscrub.llm.common import load


def corpus():
    rng = random.Random(2)

    def line(n=12):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))

    docs = [[line() for _ in range(8)] for _ in range(60)]
    passage = [line(20) for _ in range(4)]
    rows = [(i, "\n".join(d), "en", f"s{i % 5}") for i, d in enumerate(docs)]
    rows += [(100 + i, "\n".join([line(), *passage, line()]), "en", "s0") for i in range(5)]
    words = line(80).split()
    rows += [(200 + i, " ".join(words[:-1] + [f"x{i}"]), "en", "s1") for i in range(4)]
    rows += [(300, line(20) + " token = abcdef123456", "en", "s2"), (301, "\n".join(docs[0]), "en", "s3"), (302, None, None, None), (303, "", "en", "s4")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], passage


def test_stages(spark, tmp_path):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = load(spark, str(tmp_path), "documents")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = docs.collect()
    text = {r.doc_id: r.text for r in after["line_dedup"]}
    assert sum(passage[1] in (t or "") for t in text.values()) == 1 and 301 not in text and 302 in text and 303 in text
    near = {r.doc_id for r in after["near_duplicates"]}
    assert {200} == near & {200, 201, 202, 203} and set(range(60)) <= near
    assert all("abcdef123456" not in (r.text or "") for r in after["secrets"]) and len(after["secrets"]) == len(near)
    assert {r.doc_id for r in after["best_fit_packing"]} == near
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == len(after["best_fit_packing"])


def test_near_duplicates_are_dropped_by_row(spark):
    rng = random.Random(4)

    def text():
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))

    a, b, c, d, e = (text() for _ in range(5))
    rows = [
        (7, a), (3, a),          # the smaller id stays, wherever it comes
        (8, a), (8, b),          # a copy takes no other row of its id away
        (None, b), (None, c),    # a copy without an id goes, a text of its own stays
        (5, d), (5, d), (5, d + " x"),  # rows of one id
        (None, e), (None, e),
        (4, ""), (4, ""), (None, None), (9, " "),  # no words: no group
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = [(r.doc_id, r.text) for r in out.collect()]
    one_of = [x for x in got if x[0] == 5]
    assert len(one_of) == 1 and one_of[0][1] in (d, d + " x")
    want = [(3, a), (8, b), (None, c), (None, e), (4, ""), (4, ""), (None, None), (9, " ")]
    assert sorted(map(repr, (x for x in got if x[0] != 5))) == sorted(map(repr, want))


def test_stages_on_no_rows_odd_rows_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, hash long, component_id string"
    long = " ".join(f"w{i}" for i in range(60_000))
    odd = [(1, long, "en", "a", len(long), "k", 1, 2, "c"), (2, long + " x", "en", "b", None, None, None, None, None), (None, None, None, None, None, None, None, None, None),
           (3, "", "en", "a", 0, "k", 1, 2, "c"), (3, "\n\n", "en", "a", 2, "k", 1, 2, "c"), (4, "a b", None, None, 3, "k", 1, 2, "c"), (4, "a b", None, None, 3, "k", 1, 2, "c")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, rows in (("none", []), ("odd", odd)):
        docs = spark.createDataFrame(rows, schema)
        counts = []
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if stage_name != "best_fit_packing":
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name / stage_name))
            docs = spark.read.parquet(str(tmp_path / name / stage_name))
            counts.append(docs.count())
        # of the two long texts one stays, and one of the equal rows with words
        assert counts[:4] == ([0, 0, 0, 0] if not rows else [7, 7, 5, 5])
