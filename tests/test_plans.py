import pytest
from pyspark.sql import functions as F

import sparkscrub as ss
from sparkscrub.plans.recipe import Step
from sparkscrub.streaming.clean_stream import clean_stream, write_clean_stream

PEOPLE = [
    (7, "  ann LEE ", "+91-98765-43210", "ann@gmai.com", " Rome ", "₹50,000", "12/05/2001", 5),
    (8, "bob", "none", "BOB @yahooo.com", "", "75000", "2000-04-21", None),
    (7, "  ann LEE ", "+91-98765-43210", "ann@gmai.com", " Rome ", "₹50,000", "12/05/2001", 5),
    (9, "cy_o'dell", None, "cy@nodot", None, "unknown", "May 12 1998", 2),
    (10, "Dee", "98765 43211", "dee@x.org", "Oslo", "60000.50", "08/23/1995", 1),
]
SCHEMA = "id bigint, name string, contact string, email string, city string, salary string, dob string, visits bigint"


@pytest.fixture(scope="module")
def result(table):
    return ss.auto_clean(table(SCHEMA, PEOPLE))


def test_auto_clean_rows(result):
    got = [tuple(r) for r in result.data.orderBy("_row_index").collect()]
    assert got == [
        (0, 7, "Ann Lee", "9876543210", "ann@gmail.com", "Rome", 50000.0, "2001-05-12", 5.0),
        (1, 8, "Bob", "Unknown", "bob@yahoo.com", "Unknown", 75000.0, "2000-04-21", 2.0),
        (3, 9, "Cy Odell", "Unknown", "cy@nodot", "Unknown", 60000.5, "1998-05-12", 2.0),
        (4, 10, "Dee", "9876543211", "dee@x.org", "Oslo", 60000.5, "1995-08-23", 1.0),
    ]


def test_complete_columns_keep_their_type(result):
    assert dict(result.data.dtypes)["id"] == "bigint"


def test_auto_clean_audit(result):
    got = {(r["op"], r["column"]): (r["cells_changed"], r["rows_in"], r["rows_out"]) for r in result.audit.collect()}
    assert got == {
        ("dedupe", None): (1, 5, 4),
        ("clean_names", "name"): (3, 4, 4),
        ("clean_contacts", "contact"): (3, 4, 4),
        ("clean_emails", "email"): (2, 4, 4),
        ("convert", "salary"): (3, 4, 4),
        ("clean_dates", "dob"): (3, 4, 4),
        ("clean_all_strings", None): (3, 4, 4),
        ("impute", None): (6, 4, 4),
    }
    summary = ss.audit_summary(result.audit).first()
    assert (summary["rows_before"], summary["rows_after"], summary["data_types_fixed"]) == (5, 4, 1)


def test_auto_clean_does_not_lower_the_score(result):
    assert result.after.quality.first()["score"] >= result.before.quality.first()["score"]


def test_toggles(table):
    off = dict.fromkeys(("duplicates", "strings", "emails", "contacts", "dates", "nulls", "types"), False)
    only_names = ss.auto_clean(table(SCHEMA, PEOPLE), **off)
    assert [s.op for s in only_names.recipe.steps] == ["clean_names"]
    assert only_names.data.count() == 5


def test_replay(table):
    df = table(SCHEMA, PEOPLE)
    recipe = ss.Recipe().add("dedupe").add("clean_strings", "city").add("fill", "city", value="?").add("drop_nulls", "visits")
    assert recipe.replay(df, 0) is df
    assert recipe.replay(df, 1).count() == 4
    city = lambda d: [r["city"] for r in d.orderBy("_row_index").collect()]
    assert city(recipe.replay(df, 2)) == ["Rome", None, None, "Oslo"]
    assert city(recipe.replay(df, 3)) == ["Rome", "?", "?", "Oslo"]
    assert city(recipe.replay(df)) == ["Rome", "?", "Oslo"]
    audit = [(r["cells_changed"], r["rows_in"], r["rows_out"]) for r in recipe.audit(df).orderBy("step").collect()]
    assert audit == [(1, 5, 4), (2, 4, 4), (2, 4, 4), (1, 4, 3)]


def test_audit_of_neighbour_fills(table):
    df = table("v int, t string", [(None, "a"), (1, None), (None, " "), (2, "b")])
    audit = ss.Recipe().add("ffill").add("bfill", "v").audit(df).orderBy("step").collect()
    assert [r["cells_changed"] for r in audit] == [2, 1]


def test_unknown_step():
    with pytest.raises(ValueError, match="unknown step"):
        Step("polish")


@pytest.mark.parametrize(
    ("kind", "action", "op"),
    [
        ("Name", None, "clean_names"), ("Email", "Clean Email", "clean_emails"), ("Phone", None, "clean_contacts"),
        ("Date", "Fix Date", "clean_dates"), ("String", "Convert to Float", "convert"),
        ("String", "Trim Spaces", "clean_strings"), ("String", None, "clean_strings"),
    ],
)
def test_quick_fix(kind, action, op):
    assert ss.quick_fix("c", kind, action).op == op


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_result_does_not_depend_on_partitions(spark, table, partitions):
    df = table(SCHEMA, PEOPLE * 3).repartition(partitions)
    got = ss.auto_clean(df).data.orderBy("_row_index").collect()
    assert [(r["_row_index"], r["salary"], r["visits"]) for r in got] == [
        (0, 50000.0, 5.0), (1, 75000.0, 2.0), (3, 60000.5, 2.0), (4, 60000.5, 1.0)
    ]


def test_stream(spark, table, tmp_path):
    table(SCHEMA, PEOPLE).drop("_row_index").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    recipe = ss.Recipe().add("clean_emails", "email").add("clean_dates", "dob")
    query = write_clean_stream(stream, recipe, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True)
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["email"] for r in out.collect()) == sorted(
        ["ann@gmail.com", "bob@yahoo.com", "ann@gmail.com", "cy@nodot", "dee@x.org"]
    )
    with pytest.raises(ValueError, match="dedupe"):
        clean_stream(stream, ss.Recipe().add("dedupe"))


def test_shared_folder_is_read_from_the_session(spark):
    from sparkscrub.session import cut_lineage, fresh_path, shared_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named
    assert fresh_path(spark, "x").startswith(shared_dir(spark))
    assert cut_lineage(spark.range(3).withColumn("v", F.lit(1))).count() == 3


def test_workbook(spark, table, tmp_path):
    book = ss.Workbook({"a": table("v string", [(" x",), (" x",)]), "b": table("v string", [("y ",)])})
    book = book.add("dedupe").add("clean_strings", "v").switch("b").add("clean_strings", "v").add("fill", "v", value="?")
    assert book.current("a").select("v").collect()[0]["v"] == "x"
    assert [len(b.recipes["b"].steps) for b in (book, book.undo(), book.reset())] == [2, 1, 0]
    rows = {r["name"]: (r["rows"], r["is_active"], r["actions_count"]) for r in book.overview().collect()}
    assert rows == {"a": (1, False, 2), "b": (1, True, 2)}
    assert book.audit("a").count() == 2
    paths = book.write(str(tmp_path / "w"))
    assert spark.read.parquet(paths["b"]).first()["v"] == "y"
