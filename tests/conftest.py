import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkscrub.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """table("a bigint, b string", rows) with a row index in front."""

    def make(schema, rows):
        plain = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row_index bigint, " + schema)
        return plain

    return make


@pytest.fixture(scope="session")
def column(table):
    """Values of one text column in row order after applying a cleaner."""
    import sparkscrub as ss

    def run(values, cleaner, schema="c string"):
        df = ss.clean(table(schema, [(v,) for v in values]), {"c": cleaner})
        return [r["c"] for r in df.orderBy("_row_index").collect()]

    return run


@pytest.fixture(scope="session")
def report(table):
    """(cells changed, [(row, cleaned, reason)]) of a cleaner on one column."""
    import sparkscrub as ss

    def run(values, cleaner, schema="c string"):
        df = table(schema, [(v,) for v in values])
        changed = ss.count_changes(df, {"c": cleaner}).first()["cells_changed"]
        rejects = ss.first_rejects(df, "c", cleaner).collect()
        return changed, [(r["row_index"], r["cleaned"], r["reason"]) for r in rejects]

    return run
