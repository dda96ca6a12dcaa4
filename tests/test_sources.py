import os
import random

import pytest
from pyspark.sql import functions as F

import sparkscrub as ss
from sparkscrub.operators.running import dense_index
from sparkscrub.sinks.writers import directory_names, export_info
from sparkscrub.sources import grids
from sparkscrub.sources.delimited import sniff_files
from sparkscrub.sources.readers import format_of
from sparkscrub.sinks.writers import write_grid
from sparkscrub.sources.sqldump import read_sql_dump


def put(path, content, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode(encoding) if isinstance(content, str) else content)
    return str(path)


def rows(df):
    return [tuple(r)[1:] for r in df.select("_row_index", *[c for c in df.columns if c != "_row_index"]).orderBy("_row_index").collect()]


def test_format_dispatch():
    assert [format_of(p) for p in ("a.CSV", "b.tsv", "c.txt", "d.pq", "e.parquet", "f.sql", "g.docx")] == [
        "delimited", "delimited", "delimited", "parquet", "parquet", "sql", None,
    ]


@pytest.mark.parametrize(("mark", "name"), [(",", "a.csv"), (";", "b.csv"), ("\t", "c.tsv"), ("|", "d.txt")])
def test_delimiters(spark, tmp_path, mark, name):
    text = "\n".join(mark.join(r) for r in [["id", "x", "word"], ["1", "1.5", '"a,b"'], ["2", "N/A", ""]])
    df = ss.read_table(spark, put(tmp_path / name, text + "\n"))
    assert df.dtypes[1:] == [("id", "bigint"), ("x", "double"), ("word", "string")]
    assert rows(df) == [(1, 1.5, "a,b"), (2, None, None)]


def test_encodings_and_byte_order_mark(spark, tmp_path):
    bom = put(tmp_path / "bom.csv", "﻿sr,name\n1,Zoë\n")
    old = put(tmp_path / "old.csv", "sr,name\n2,Zoë – “x”\n", "cp1252")
    found = {os.path.basename(r["file"]): r["encoding"] for r in sniff_files(spark, [bom, old]).collect()}
    assert found == {"bom.csv": "utf-8", "old.csv": "cp1252"}
    assert rows(ss.read_delimited(spark, bom).data) == [(1, "Zoë")]
    assert rows(ss.read_delimited(spark, [bom, old]).data) == [(1, "Zoë"), (2, "Zoë – “x”")]


def test_bad_rows_are_set_aside_and_short_rows_kept(spark, tmp_path):
    path = put(tmp_path / "x.csv", 'a,b\n1,x\n2,y,extra\n3\n4,"p,q"\n')
    read = ss.read_delimited(spark, path)
    assert rows(read.data) == [(1, "x"), (3, None), (4, "p,q")]
    assert [r["text"] for r in read.bad_rows.collect()] == ["2,y,extra"]
    assert (read.data.count(), read.data.select("a").count(), read.bad_rows.count()) == (3, 3, 1)


def test_text_files_are_profiled_in_one_scan(spark, tmp_path):
    df = ss.read_delimited(spark, put(tmp_path / "x.csv", "a,b,c\n1,x,\n2,x,N/A\n2,,y\n")).data
    profile = ss.analyze_nulls(df)
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    got = {r["column"]: (r["null_count"], r["unique_values"], r["duplicate_values"]) for r in profile.collect()}
    assert got == {"a": (0, 2, 1), "b": (1, 1, 1), "c": (2, 1, 0)}


def test_quoted_line_breaks(spark, tmp_path):
    path = put(tmp_path / "x.csv", 'a,b\n1,"two\nlines"\n2,"say ""hi"""\n')
    assert rows(ss.read_delimited(spark, path).data) == [(1, "two\nlines"), (2, 'say "hi"')]


def test_header_repairs(spark, tmp_path):
    df = ss.read_delimited(spark, put(tmp_path / "x.csv", "a,,a,b c\n1,2,3,4\n")).data
    assert df.columns == ["_row_index", "a", "Unnamed: 1", "a.1", "b c"]


def test_types_are_inferred_whole(spark, tmp_path):
    body = "i,f,b,t,n\n1,1,True,x,\n-2,2.5,false,7,\n,,,,\n"
    df = ss.read_delimited(spark, put(tmp_path / "x.csv", body)).data
    assert [d for _, d in df.dtypes[1:]] == ["bigint", "double", "boolean", "string", "string"]


def test_row_index_follows_files_and_blocks(spark, tmp_path):
    for part, start in (("b", 1000), ("a", 0), ("c", 2000)):
        put(tmp_path / "d" / f"{part}.csv", "v\n" + "\n".join(str(start + i) for i in range(1000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        df = ss.read_delimited(spark, str(tmp_path / "d")).data
        assert df.rdd.getNumPartitions() > 10
        assert [r["v"] for r in df.orderBy("_row_index").collect()] == list(range(3000))
        assert [tuple(r) for r in dense_index(df).orderBy("_row_index").collect()] == [(i, i) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parquet_round_trip_and_info(spark, tmp_path, table):
    df = table("id bigint, name string", [(1, "x"), (2, None)])
    path = str(tmp_path / "out")
    ss.write_parquet(df, path)
    back = ss.read_parquet(spark, path)
    assert sorted(tuple(r)[:2] for r in back.select("id", "name").collect()) == [(1, "x"), (2, None)]
    info = export_info(df, path, "parquet", "snappy")
    assert (info["rows"], info["columns"], info["column_names"]) == (2, 2, ["id", "name"])
    assert info["file_size_bytes"] > 0


def by_pandas_rules(text, delimiter=","):
    """Records of delimited text: a quote opens a field only at its beginning."""
    rows, row, cell, state = [], [], "", "start"
    for c in text:
        if state == "quoted":
            if c == '"':
                state = "maybe"
            else:
                cell += c
        elif c == '"' and state in ("start", "maybe"):
            cell += '"' if state == "maybe" else ""
            state = "quoted"
        elif c in (delimiter, "\n"):
            row.append(cell)
            cell, state = "", "start"
            if c == "\n":
                rows.append(row)
                row = []
        else:
            cell, state = cell + c, "plain"
    return [r for r in rows if r != [""]]


def test_fields_that_run_over_lines(spark, tmp_path):
    rng = random.Random(5)
    for n in range(3):
        cells = ['"a, b"', 'x', '"two\nlines"', '5"', '"say ""hi""\n\n, there"', 'q" r "s', '""', "7"]
        body = "".join(f"{i},{rng.choice(cells)},{rng.choice(cells)}\n" for i in range(300))
        text = "id,one,two\n" + body
        path = put(tmp_path / f"f{n}.csv", text)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
            read = ss.read_delimited(spark, path, delimiter=",", infer=False)
            got = [[x or "" for x in r[1:]] for r in read.data.orderBy("_row_index").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == by_pandas_rules(text)[1:] and read.bad_rows.collect() == []
        assert [r["id"] for r in read.data.orderBy("_row_index").collect()] == [str(i) for i in range(300)]


def test_quotes_that_open_nothing(spark, tmp_path):
    plain = ss.read_delimited(spark, put(tmp_path / "a.csv", 'id,size\n1,5" pipe\n2,6" pipe\n3,x\n'))
    assert [f["multi_line"] for f in plain.formats] == [False]
    assert rows(plain.data) == [(1, '5" pipe'), (2, '6" pipe'), (3, "x")]
    cut = ss.read_delimited(spark, put(tmp_path / "b.csv", 'id,size\n1,"5\n2,y\n3,z\n'))
    assert rows(cut.data) == [(1, '"5'), (2, "y"), (3, "z")] and cut.bad_rows.collect() == []
    for i in range(3):  # read in one task
        put(tmp_path / "s" / f"{i}.csv", f'id,size\n{2 * i},x\n{2 * i + 1},"y\n\n')
    several = ss.read_delimited(spark, str(tmp_path / "s")).data.orderBy("_row_index")
    assert rows(several) == [(i, '"y' if i % 2 else "x") for i in range(6)]


def test_formats_of_one_name_are_tables_of_their_own(spark, tmp_path):
    put(tmp_path / "s" / "a.csv", "x,y\n1,2\n")
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next(f for f in os.listdir(tmp_path / "p") if f.endswith(".parquet"))
    os.link(tmp_path / "p" / part, tmp_path / "s" / "a.parquet")
    back = ss.read_table_set(spark, str(tmp_path / "s"), row_index=False)
    assert {n: (t.columns, t.count()) for n, t in back.items()} == {"a": (["x", "y"], 1), "a (parquet)": (["id"], 3)}


def test_row_index_of_several_parquet_files(spark, tmp_path):
    spark.range(100).repartitionByRange(4, "id").write.parquet(str(tmp_path / "p"))
    got = [r["id"] for r in ss.read_parquet(spark, str(tmp_path / "p")).orderBy("_row_index").collect()]
    assert got == list(range(100))
    assert ss.read_parquet(spark, str(tmp_path / "p")).filter("_row_index IS NULL").isEmpty()


def test_untidy_types_are_stored_as_text(spark, tmp_path):
    df = spark.sql("SELECT 0L AS _row_index, INTERVAL '1' DAY AS d, NULL AS n, array(1) AS a")
    ss.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).dtypes == [("d", "string"), ("n", "string"), ("a", "array<int>")]
    ss.write_csv(df.drop("d"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["a"] == "[1]"


def test_table_set(spark, tmp_path, table):
    a, b = table("id bigint", [(1,), (2,)]), table("amount double, order_date string", [(1.5, "2020-01-01")])
    paths = ss.write_table_set({"Customers": a, "Orders!": b, "All Tables (Union / Disjointed)": a}, str(tmp_path / "s"), "csv")
    assert sorted(os.path.basename(p) for p in paths.values()) == ["Customers", "Orders"]
    back = ss.read_table_set(spark, str(tmp_path / "s"))
    assert {n: t.count() for n, t in back.items()} == {"Customers": 2, "Orders": 1}
    assert directory_names(["a b", "a  b", "??"]) == {"a b": "a_b", "a  b": "a_b_2", "??": "Table_3"}


DUMP = """-- it's a dump; really
CREATE TABLE people (id INT, name VARCHAR(9));
INSERT INTO `people` (id, name, score) VALUES
(1, '  O''Neil; Ann ', 1.5),
(2, 'a, b (c)', NULL), (3, "dq, 'x'", 2);
INSERT INTO other VALUES (10, 'x'), (11, NULL);
insert into people (name, id) values ('late', 4);
INSERT INTO people (id, name, score) VALUES (5);
INSERT INTO people
    (id, name, score)
VALUES
    (
        6,
        'two
-- lines; (of it''s', 0.5
    ),
    (7, '', -1); -- that's it
INSERT INTO people (name) VALUES ('x
-- y''s');
-- isn't
INSERT INTO other VALUES (12, 'INSERT INTO people VALUES (0);')
"""


def test_sql_dump(spark, tmp_path):
    dump = read_sql_dump(spark, put(tmp_path / "d.sql", DUMP))
    assert dump.tables() == ["people", "other"]
    people = dump.table("people")
    assert people.dtypes[1:] == [("id", "bigint"), ("name", "string"), ("score", "double")]
    want = [(1, "  O'Neil; Ann ", 1.5), (2, "a, b (c)", None), (3, "dq, 'x'", 2.0), (4, "late", None), (5, None, None)]
    want += [(6, "two\n-- lines; (of it's", 0.5), (7, "", -1.0), (None, "x\n-- y's", None)]
    assert rows(people) == want
    other = [(10, "x"), (11, None), (12, "INSERT INTO people VALUES (0);")]
    assert rows(dump.table("other")) == other
    assert rows(ss.read_table(spark, str(tmp_path / "d.sql"), "other")) == other


def test_one_statement_over_many_blocks(spark, tmp_path):
    body = ",\n".join(f"({i}, 'name {i}; it''s')" for i in range(900))
    put(tmp_path / "d" / "a.sql", f"INSERT INTO t (a, b) VALUES\n{body};\n")
    put(tmp_path / "d" / "b.sql", "(1, 'no head');\nINSERT INTO t VALUES (900, 'x');\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        table = read_sql_dump(spark, str(tmp_path / "d")).table("t")
        got = [(r["_row_index"], r["a"]) for r in table.orderBy("_row_index").collect()]
        assert got[:900] == [(i, i) for i in range(900)] and len(got) == 901
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sql_dump_without_rows(spark, tmp_path):
    dump = read_sql_dump(spark, put(tmp_path / "d.sql", "CREATE TABLE a (x INT);\nCREATE TABLE IF NOT EXISTS b (y INT);"))
    assert dump.tables() == ["a", "b"]


@pytest.fixture(scope="module")
def grid(spark):
    table_1 = [["Order\nID", "Product Name  ", "Price", None, "Price"], ["1", " Mouse \n Optical", "9", ""], ["2", "Pad", "3", "x", "y", "z"]]
    table_2 = [["A (long)", "B"], ["1", "2"]]
    lines = [(1, 1, 1, i, c) for i, c in enumerate(table_1)] + [(1, 2, 1, i, c) for i, c in enumerate(table_2)]
    lines += [(1, 3, 1, 0, ["Only", "Header"])]
    return spark.createDataFrame(lines, "doc_id int, page int, table int, row_no int, cells array<string>")


def test_grids(grid):
    tables = grids.grid_tables(grid, 1)
    assert list(tables) == ["Page 1 - Table 1 (Order ID)", "Page 2 - Table 1 (A)"]
    first = tables["Page 1 - Table 1 (Order ID)"]
    assert first.columns[1:] == ["Order ID", "Product Name", "Price", "Column_4", "Price_1"]
    assert rows(first) == [("1", "Mouse Optical", "9", None, None), ("2", "Pad", "3", "x", "y")]
    info = grids.inspect_grids(grid).orderBy("page_number").collect()
    assert [(r["id"], r["rows"], r["columns"], r["total_tables"], r["columns_match"]) for r in info] == [
        ("page_1_table_1", 2, 5, 2, False), ("page_2_table_1", 1, 2, 2, False),
    ]


def test_grids_are_written_by_header(spark, grid, tmp_path):
    paths = write_grid(grid, 1, str(tmp_path / "g"), "parquet")
    assert sorted(paths) == ["Page 1 - Table 1 (Order ID)", "Page 2 - Table 1 (A)"]
    first = spark.read.parquet(paths["Page 1 - Table 1 (Order ID)"])
    assert first.columns == ["Order ID", "Product Name", "Price", "Column_4", "Price_1"]
    assert sorted(map(tuple, first.collect())) == [("1", "Mouse Optical", "9", None, None), ("2", "Pad", "3", "x", "y")]
    assert [tuple(r) for r in spark.read.parquet(paths["Page 2 - Table 1 (A)"]).collect()] == [("1", "2")]
    one = write_grid(grid.filter("page = 2"), 1, str(tmp_path / "h"), "csv")
    assert list(one) == ["converted"] and spark.read.csv(one["converted"], header=True).columns == ["A (long)", "B"]
    assert write_grid(grid, 99, str(tmp_path / "i")) == {}


def test_table_names(spark):
    names = spark.createDataFrame(
        [(["Column_1", "x", "A telling name that is long (really)"],), (["Column_1"],), ([],)], "n array<string>"
    )
    got = names.select(grids.table_name(F.lit(2), F.lit(3), F.col("n")).alias("t")).collect()
    assert [r["t"] for r in got] == ["Page 2 - Table 3 (A telling name tha)", "Page 2 - Table 3", "Page 2 - Table 3"]
