import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, score double, node string, shard int"


def as_rows(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), True, "r", 1.0, "n", 3) for i, t, s in rows], SCHEMA)


BASE = "one two three four five six seven eight nine ten eleven twelve\nthe second line is here\nand a third line follows\nlast line"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, repeated rows, ties, a very long text, and a null source."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [
        (1, BASE, "a"), (2, BASE, "a"), (2, BASE, "a"), (3, None, "b"), (4, "", None), (5, " \t\n\v ", "b"), (None, BASE + " more", "a"),
        (6, long, "c"), (7, "short", None), (8, "a b c d e a b c d e a b c d e", "c"), (9, "\n\n\n\n\n", "c"), (10, "é ß 漢字 😀\u2028x", "d"),
        (11, "A\nB\nC\nA\nB\nC\nD", "d"), (12, "A\nB\nC\nE", "d"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return as_rows(spark, edge_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return as_rows(spark, [])
