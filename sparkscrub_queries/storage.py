"""Readers, writers, table sets, extracted grids, dumps, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import sparkscrub as ss
from sparkscrub.session import fresh_path
from sparkscrub.sinks.writers import json_safe, write_grid
from sparkscrub.sources import grids
from sparkscrub.sources.delimited import NA_TOKENS, infer_types, na_to_null, sniff
from sparkscrub.sources.rowid import parquet_place, with_file_index
from sparkscrub.sources.sqldump import parse_dump
from sparkscrub.streaming.clean_stream import write_clean_stream
from sparkscrub_queries import sql as q
from sparkscrub_queries.inputs import (
    CROWD_SQL, PEOPLE, PEOPLE_SQL, crowd, dump_lines, grid, people, table,
)

# ---- files --------------------------------------------------------------------------------


def csv_round_trip(spark, sf):
    """Write people as CSV in several files, read them back with everything inferred."""
    path = fresh_path(spark, "csv")
    rows = people(spark, sf)
    ss.write_csv(rows.repartitionByRange(4, "customer_id").sortWithinPartitions("customer_id"), path)
    return ss.read_delimited(spark, path).data.drop("_row_index")


_NA = q.in_list(NA_TOKENS)
_CSV_BACK = q.with_(
    PEOPLE_SQL,
    "SELECT customer_id, "
    + ", ".join(f"CASE WHEN {c} IN {_NA} THEN NULL ELSE {c} END AS {c}" for c in list(PEOPLE)[1:])
    + " FROM people",
)


def csv_row_order(spark, sf):
    """The file-order index of a CSV read gives back the order the rows were written in."""
    path = fresh_path(spark, "csv-order")
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    ss.write_csv(parts.repartitionByRange(6, "p_partkey").sortWithinPartitions("p_partkey"), path)
    from sparkscrub.operators.running import dense_index

    return dense_index(ss.read_delimited(spark, path).data)


def _text_files(spark, rows, header: str, line, label: str, order: str, files: int = 3, ending: str = "") -> str:
    """Rows written as lines of text under a header, in several files."""
    path = fresh_path(spark, label) + ending
    parts = rows.repartitionByRange(files, order).sortWithinPartitions(order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts.select(F.when(place == 0, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value")).write.text(path)
    return path


def csv_multiline(spark, sf):
    """Customers whose names run over two lines, beside quotes that open nothing."""
    line = F.concat("c_custkey", F.lit(',"'), "c_name", F.lit("\n"), "c_mktsegment", F.lit(', ""x""",5" '), "c_custkey")
    path = _text_files(spark, table(spark, sf, "customer"), "id,name,size", line, "csv-lines", "c_custkey")
    return ss.read_delimited(spark, path).data.drop("_row_index")


def csv_stray_quote(spark, sf):
    """Quotes within fields, and one at the end of each file that nothing closes."""
    c = table(spark, sf, "customer").withColumn("last", F.col("c_custkey") % 500 == 499)
    line = F.concat("c_custkey", F.when(F.col("last"), F.lit(',"')).otherwise(F.lit(',5" ')), "c_name", F.when(F.col("last"), F.lit("\n")).otherwise(F.lit("")))
    path = fresh_path(spark, "csv-stray")
    parts = c.withColumn("file", F.floor(F.col("c_custkey") / 500)).repartition("file").sortWithinPartitions("file", "c_custkey")
    head = F.when(F.col("c_custkey") % 500 == 0, F.lit("id,size\n")).otherwise(F.lit(""))
    parts.select("file", F.concat(head, line).alias("value")).write.partitionBy("file").text(path)
    return ss.read_delimited(spark, [f"{path}/*"]).data.drop("_row_index")


def csv_bad_rows(spark, sf):
    """Rows with more fields than the header are told with their text, the others read."""
    n = F.col("c_custkey")
    line = F.concat(n, F.lit(";"), "c_name", F.when(n % 9 == 0, F.lit(";too;many")).otherwise(F.lit("")))
    read = ss.read_delimited(spark, _text_files(spark, table(spark, sf, "customer"), "id;name", line, "csv-bad", "c_custkey"))
    good = read.data.select(F.col("id").cast("string").alias("id"), "name", F.lit(None).cast("string").alias("text"))
    return good.unionByName(read.bad_rows.select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), "text"))


def csv_mixed_files(spark, sf):
    """One folder with files of their own delimiter, encoding and columns, read as one table."""
    path = fresh_path(spark, "csv-mixed")
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Café "), "c_name").alias("name")).coalesce(1).write.csv(
        f"{path}/a", header=True, sep=";", encoding="ISO-8859-1")
    s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Größe "), "s_name").alias("name"), F.col("s_nationkey").alias("nation")).coalesce(1).write.csv(
        f"{path}/b", header=True, sep="|")
    read = ss.read_delimited(spark, [f"{path}/a", f"{path}/b"])
    kinds = sorted((f["encoding"], f["delimiter"]) for f in read.formats)
    return read.data.drop("_row_index").withColumn("kinds", F.lit(str(kinds)))


def read_by_name(spark, sf):
    """Nations as delimited text, as parquet and as a dump, each read by what its name ends in."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    base = fresh_path(spark, "named")
    ss.write_csv(n, f"{base}/n.CSV")
    n.write.parquet(f"{base}/n.pq")
    n.select(F.concat(F.lit("INSERT INTO nations (n_nationkey, n_name) VALUES ("), "n_nationkey", F.lit(", '"), "n_name", F.lit("');")).alias("value")).write.text(f"{base}/n.sql")
    parts = [ss.read_table(spark, f"{base}/n{end}", row_index=False).select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.lit(end).alias("ending"))
             for end in (".CSV", ".pq", ".sql")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def parquet_round_trip(spark, sf):
    path = fresh_path(spark, "parquet")
    ss.write_parquet(table(spark, sf, "events"), path, compression="zstd")
    back = ss.read_parquet(spark, path, row_index=False)
    return back.select("event_id", "ts", "user_id", "event_type", "value", "props")


def parquet_row_order(spark, sf):
    """The row index of one parquet file is its row number."""
    return with_file_index(table(spark, sf, "orders"), parquet_place()).select("_row_index", "o_orderkey")


def file_facts(spark, sf):
    info = ss.file_info(table(spark, sf, "lineitem"))
    names = F.array_join("column_names", ",").alias("column_names")
    return info.select("files", "rows", "columns", names, (F.col("file_size_bytes") > 0).alias("has_bytes"))


def table_set_round_trip(spark, sf):
    """Two tables written as a set, read back as a set, counted."""
    path = fresh_path(spark, "set")
    ss.write_table_set({"Customers": people(spark, sf), "Who Bought": table(spark, sf, "orders")}, path, "parquet")
    back = ss.read_table_set(spark, path)
    return ss.tables_overview(back, actions={"Customers": 2}, active="Customers")


def json_round_trip(spark, sf):
    """Not-a-number and infinities leave as null."""
    path = fresh_path(spark, "json")
    odd = (
        F.when(F.col("event_id") % 5 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 7 == 0, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    ss.write_json(table(spark, sf, "events").select("event_id", odd.alias("value"), "event_type"), path)
    return spark.read.schema("event_id bigint, value double, event_type string").json(path)


def json_safe_nested(spark, sf):
    """The same inside arrays and structs."""
    nan = F.lit(float("nan"))
    nested = table(spark, sf, "events").select(
        "event_id",
        F.array(F.col("value"), F.when(F.col("event_id") % 2 == 0, nan).otherwise(F.col("value"))).alias("a"),
        F.struct(F.when(F.col("event_id") % 3 == 0, nan).otherwise(F.col("value")).alias("x")).alias("s"),
    )
    safe = json_safe(nested)
    return safe.select("event_id", F.col("a")[0].alias("a0"), F.col("a")[1].alias("a1"), F.col("s.x").alias("sx"))


def inferred_types(spark, sf):
    """Numbers, flags and NA tokens as text, brought back to types."""
    raw = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_id") % 13 == 0, "N/A").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_id") % 2 == 0, "True").otherwise("false").alias("even"),
        F.when(F.col("event_id") % 17 == 0, "#N/A").otherwise(F.col("event_type")).alias("event_type"),
    )
    return infer_types(na_to_null(raw))


def delimiters(spark, sf):
    """Encoding and delimiter of one 'file' per market segment, each with its own separator."""
    c = table(spark, sf, "customer")
    mark = F.element_at(F.array(*[F.lit(m) for m in (",", ";", "\t", "|")]), (F.length("c_mktsegment") % 4 + 1).cast("int"))
    line = F.concat(
        F.lit('"a, '), "c_name", F.lit('"'), mark, "c_nationkey", mark, F.lit("1.5"),
        F.when(F.col("c_custkey") % 9 == 0, mark).otherwise(F.lit("")),
    )
    lines = c.select(F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("place"), line.alias("line"))
    found = sniff(lines)
    return found.select("file", "encoding", "delimiter", "multi_line", "lines")


# ---- table sets ---------------------------------------------------------------------------


def _by_nation(spark, sf):
    c = table(spark, sf, "customer")
    s = table(spark, sf, "supplier")
    return (
        c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")),
        s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")),
    )


def union_same(spark, sf):
    a, b = _by_nation(spark, sf)
    return ss.select_table({"Page 1 - Table 1 (id)": a, "Page 2 - Table 1 (id)": b})[1]


def union_disjoint(spark, sf):
    a, b = _by_nation(spark, sf)
    tables = {"people": a.drop("nation"), "firms": b.withColumn("kind", F.lit("firm"))}
    return ss.select_table(tables, "All Tables (Union / Disjointed)")[1]


def union_order(spark, sf):
    """A union's new row index keeps the order of the tables and of their rows."""
    a, b = _by_nation(spark, sf)
    # as if the rows came from files of ranks above 256
    place = F.shiftleft(F.lit(300).cast("bigint"), 40) + F.col("id") * 1000
    return ss.union_tables([t.withColumn("_row_index", place) for t in (a, b)])


def selected_table(spark, sf):
    a, b = _by_nation(spark, sf)
    name, df = ss.select_table({"people": a, "Firms of the World": b.drop("nation")}, "firms")
    return df.withColumn("table_name", F.lit(name))


def schema_match(spark, sf):
    a, b = _by_nation(spark, sf)
    return a.agg(
        F.lit(ss.schemas_match([a, b])).alias("same"), F.lit(ss.schemas_match([a, b.drop("id")])).alias("other"),
        F.lit(ss.schemas_match([a])).alias("single"), F.count(F.lit(1)).alias("rows"),
    )


def table_overview(spark, sf):
    tables = {"customer": table(spark, sf, "customer"), "part": table(spark, sf, "part")}
    return ss.tables_overview(tables, actions={"part": 3}, active="customer")


def workbook_overview(spark, sf):
    """Steps on two tables, one of them undone, and the first table still as it was left."""
    book = ss.Workbook({"crowd": crowd(spark, sf), "parts": table(spark, sf, "part")})
    book = book.add("dedupe").add("clean_emails", "email").switch("parts").add("clean_strings", "p_name")
    return book.undo().switch("crowd").overview()


_WORKBOOK = q.with_(
    CROWD_SQL,
    f"""SELECT 'crowd' AS name, COUNT(*) AS rows, 9 AS columns, true AS is_active, true AS is_cleaned,
    2 AS actions_count FROM (SELECT DISTINCT {', '.join(PEOPLE)} FROM crowd)
    UNION ALL SELECT 'parts', COUNT(*), 6, false, false, 0 FROM part""",
)


def table_names(spark, sf):
    """The name of every extracted table, made from its page, number and first column."""
    heads = grids.headers(grid(spark, sf))
    return heads.select(*grids.KEYS, grids.table_name(F.col("page"), F.col("table"), F.col("names")).alias("name"))


# ---- extracted grids ----------------------------------------------------------------------


_GRID_SQL = """cells AS (SELECT o_custkey AS doc_id, CAST(year(o_orderdate) AS INT) AS page, 1 AS "table",
    o_orderkey + 1 AS row_no, CAST(o_orderkey AS STRING) AS order_key, o_orderstatus AS status,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(trunc(o_totalprice) AS BIGINT) AS STRING) END AS price,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE regexp_replace(o_orderpriority, '-', ' - ', 'g') END AS priority
    FROM orders)"""


def grid_to_table(spark, sf):
    """Every extracted row under its cleaned header, short rows padded, long rows cut."""
    rows = grids.data_rows(grid(spark, sf))
    return rows.select(
        *grids.KEYS, "row_no", F.array_join("names", "|").alias("names"),
        *[F.col("cells")[i].alias(f"cell_{i + 1}") for i in range(5)],
    )


_GRID_ROWS = q.with_(
    _GRID_SQL,
    """SELECT doc_id, page, "table", row_no, 'Order Key|Status (code)|Price|Column_4|Price_1' AS names,
    order_key AS cell_1, status AS cell_2, price AS cell_3, priority AS cell_4, CAST(NULL AS STRING) AS cell_5 FROM cells""",
)


def grid_inspect(spark, sf):
    info = grids.inspect_grids(grid(spark, sf))
    flat = F.transform("preview", lambda r: F.coalesce(F.array_join(r, ",", "-"), F.lit("")))
    return info.withColumn("preview", F.array_join(flat, ";")).withColumn(
        "column_names", F.array_join("column_names", "|")
    )


_GRID_INSPECT = q.with_(
    _GRID_SQL,
    """SELECT doc_id, 'page_' || page || '_table_1' AS id, 'Page ' || page || ' - Table 1 (Order Key)' AS name,
    page AS page_number, 1 AS table_index, COUNT(*) AS rows, 5 AS columns,
    'Order Key|Status (code)|Price|Column_4|Price_1' AS column_names,
    string_agg(line, ';' ORDER BY row_no) FILTER (n <= 5) AS preview,
    COUNT(*) OVER (PARTITION BY doc_id) AS total_tables, true AS columns_match
    FROM (SELECT *, order_key || ',' || status || ',' || COALESCE(price, '-') || ',' || COALESCE(priority, '-') || ',-' AS line,
        row_number() OVER (PARTITION BY doc_id, page ORDER BY row_no) AS n FROM cells)
    GROUP BY doc_id, page""",
)


_GRID_COLUMNS = {"Order Key": "order_key", "Status (code)": "status", "Price": "price", "Column_4": "priority", "Price_1": "fifth"}


def grid_export(spark, sf):
    """All orders as one document: its tables are combined, written as one CSV and read back."""
    path = fresh_path(spark, "extracted")
    paths = write_grid(grid(spark, sf, doc="1L"), 1, path, "csv")
    back = spark.read.option("header", True).csv(list(paths.values()))
    return back.select(*[F.col(f"`{c}`").alias(n) for c, n in _GRID_COLUMNS.items()])


def grid_export_apart(spark, sf):
    """The same where odd years have a header of their own: a folder for each table."""
    path = fresh_path(spark, "extracted")
    cells = grid(spark, sf, doc="1L")
    odd = F.transform("cells", lambda c: F.when(c == "Price", "Cost").otherwise(c))
    paths = write_grid(cells.withColumn("cells", F.when(F.col("page") % 2 == 1, odd).otherwise(F.col("cells"))), 1, path, "parquet")
    parts = [spark.read.parquet(p).withColumn("name", F.lit(n)) for n, p in sorted(paths.items())]
    told = [p.select("name", F.lit(",".join(p.columns)).alias("columns"), F.col("`Order Key`").alias("order_key")) for p in parts]
    return reduce(DataFrame.unionByName, told)


_GRID_EXPORT = q.with_(_GRID_SQL, "SELECT order_key, status, price, priority, CAST(NULL AS STRING) AS fifth FROM cells")
_GRID_APART = q.with_(
    _GRID_SQL,
    """SELECT 'Page ' || page || ' - Table 1 (Order Key)' AS name, order_key,
    CASE WHEN page % 2 = 1 THEN 'Order Key,Status (code),Cost,Column_4,Cost_1,name' ELSE 'Order Key,Status (code),Price,Column_4,Price_1,name' END AS columns
    FROM cells""")

# ---- SQL dumps ----------------------------------------------------------------------------


def sql_dump_load(spark, sf):
    return parse_dump(dump_lines(spark, sf)).table("people")


_DUMP = """SELECT CAST(2 * (row_number() OVER (ORDER BY c_custkey) - 1) AS BIGINT) AS _row_index, c_custkey AS id,
    CASE WHEN c_custkey % 7 = 0 THEN 'O''Neil;' || chr(10) || '-- ' || c_name
        WHEN c_custkey % 7 = 1 THEN 'O' || chr(39) || 'Hara ' || chr(92) || c_name ELSE c_name END AS name,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment,
    CAST(c_nationkey AS DOUBLE) + 0.5 AS score FROM customer
    UNION ALL SELECT CAST(2 * (row_number() OVER (ORDER BY c_custkey) - 1) + 1 AS BIGINT), -c_custkey,
    'twin, of (' || c_custkey || ')', NULL, NULL FROM customer"""


def sql_dump_dialects(spark, sf):
    """All customers as three dumps, each with a backslash of its own meaning, and a statement that never ends.

    One writes literals in standard form, one dollar-quoted texts and E literals, one MySQL's escapes."""
    c = table(spark, sf, "customer")
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    texts = {
        0: F.concat(F.lit("INSERT INTO \"people\" VALUES ("), key, F.lit(", 'C:\\"), name, F.lit("\\', 'it''s');")),
        1: F.concat(F.lit("INSERT INTO people VALUES ("), key, F.lit(", $$C:\\"), name, F.lit("\\$$, E'it\\'s');")),
        2: F.concat(F.lit("INSERT INTO `people` VALUES ("), key, F.lit(", 'C:\\\\"), name, F.lit("\\\\', 'it\\'s'); # it's")),
    }
    kind = F.col("c_custkey") % 3
    text = F.when(kind == 0, texts[0]).when(kind == 1, texts[1]).otherwise(texts[2])
    lines = c.select(F.concat(F.lit("d"), kind, F.lit(".sql")).alias("file"), F.col("c_custkey").cast("bigint").alias("place"), text.alias("text"))
    cut = lines.where("place BETWEEN 1 AND 3").select("file", F.lit(1 << 39).alias("place"), F.lit("INSERT INTO people VALUES (0, 'cut").alias("text"))
    dump = parse_dump(lines.unionByName(cut))
    people = dump.table("people").drop("_row_index")
    return people.unionByName(dump.bad_rows.select(F.lit(-1).cast("bigint").alias("column_1"), F.col("file").alias("column_2"), F.col("text").alias("column_3")))


_DIALECTS = """SELECT c_custkey AS column_1, 'C:' || chr(92) || c_name || chr(92) AS column_2, 'it' || chr(39) || 's' AS column_3 FROM customer
    UNION ALL SELECT -1, 'd' || (c_custkey % 3) || '.sql', 'INSERT INTO people VALUES (0, ' || chr(39) || 'cut' FROM customer WHERE c_custkey BETWEEN 1 AND 3"""


def sql_dump_bad_rows(spark, sf):
    """Statements that insert no values, and so give no rows."""
    n = table(spark, sf, "nation")
    lines = n.select(
        F.lit("d.sql").alias("file"), F.col("n_nationkey").cast("bigint").alias("place"),
        F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("INSERT INTO a SELECT * FROM b WHERE x = '"), "n_name", F.lit("';")))
        .otherwise(F.concat(F.lit("INSERT INTO a VALUES ('INSERT INTO', '"), "n_name", F.lit("');"))).alias("text"))
    return parse_dump(lines).bad_rows.select("place", "text")


def sql_dump_created(spark, sf):
    """The tables of a dump without rows, from its CREATE statements."""
    n = table(spark, sf, "nation")
    lines = n.select(
        F.lit("d.sql").alias("file"), F.col("n_nationkey").cast("bigint").alias("place"),
        F.concat(F.lit("CREATE TABLE IF NOT EXISTS `main`.`t_"), F.col("n_nationkey").cast("string"), F.lit("` (x INT);")).alias("text"))
    return spark.createDataFrame([(t,) for t in parse_dump(lines).tables()], "table_name string")


def sql_dump_file(spark, sf):
    """Nations as a dump file on disk, read by the format of its name."""
    path = fresh_path(spark, "dump")
    n = table(spark, sf, "nation")
    line = F.concat(
        F.lit("INSERT INTO nations VALUES ("), F.col("n_nationkey").cast("string"), F.lit(", '"), "n_name", F.lit("', NULL);")
    )
    n.select(line.alias("value")).write.text(path)
    dump = ss.read_sql_dump(spark, path)
    name = dump.pick("no such table")
    return dump.table(name).drop("_row_index").withColumn("table_name", F.lit(name))


# ---- streams ------------------------------------------------------------------------------


def stream_clean(spark, sf):
    """The cell-wise steps on a stream of customer files, run until all files are read."""
    schema = table(spark, sf, "customer").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
    stream = stream.selectExpr(*[f"{e} AS {n}" for n, e in PEOPLE.items()])
    recipe = ss.Recipe().add("clean_emails", "email").add("clean_names", "surname").add("clean_all_strings")
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    query = write_clean_stream(stream, recipe, out, state, availableNow=True)
    query.awaitTermination()
    return spark.read.parquet(out)


_STREAM = q.with_(
    PEOPLE_SQL,
    f"SELECT customer_id, {q.no_blank(q.squeeze(q.email('email')))} AS email, {q.no_blank(q.name('surname'))} AS surname, "
    + ", ".join(
        f"{q.no_blank(q.squeeze(c))} AS {c}" for c in ("name", "contact", "city", "joined", "salary", "is_active")
    )
    + " FROM people",
)

QUERIES = {
    "csv_round_trip": (csv_round_trip, _CSV_BACK),
    "csv_row_order": (
        csv_row_order,
        """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS _row_index, p_partkey, CAST(p_size AS BIGINT) AS p_size,
        p_retailprice FROM part""",
    ),
    "csv_multiline": (
        csv_multiline,
        """SELECT CAST(c_custkey AS BIGINT) AS id, c_name || chr(10) || c_mktsegment || ', "x"' AS name, '5" ' || c_custkey AS size FROM customer""",
    ),
    "csv_stray_quote": (
        csv_stray_quote,
        """SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 500 = 499 THEN '"' ELSE '5" ' END || c_name AS size FROM customer""",
    ),
    "csv_bad_rows": (
        csv_bad_rows,
        """SELECT CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey AS STRING) END AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS name,
        CASE WHEN c_custkey % 9 = 0 THEN c_custkey || ';' || c_name || ';too;many' END AS text FROM customer""",
    ),
    "csv_mixed_files": (
        csv_mixed_files,
        """SELECT *, '[(''cp1252'', '';''), (''utf-8'', ''|'')]' AS kinds FROM (
        SELECT CAST(c_custkey AS BIGINT) AS id, 'Café ' || c_name AS name, CAST(NULL AS BIGINT) AS nation FROM customer
        UNION ALL SELECT s_suppkey, 'Größe ' || s_name, s_nationkey FROM supplier)""",
    ),
    "read_by_name": (
        read_by_name,
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, ending FROM nation, (SELECT unnest(['.CSV', '.pq', '.sql']) AS ending)",
    ),
    "parquet_round_trip": (
        parquet_round_trip, "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    ),
    "parquet_row_order": (
        parquet_row_order, "SELECT row_number() OVER () - 1 AS _row_index, o_orderkey FROM orders",
    ),
    "file_info": (
        file_facts,
        """SELECT CAST(1 AS BIGINT) AS files, COUNT(*) AS rows, 11 AS columns,
        'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,'
        || 'l_linestatus,l_shipdate' AS column_names, true AS has_bytes FROM lineitem""",
    ),
    "table_set_round_trip": (
        table_set_round_trip,
        """SELECT 'Customers' AS name, COUNT(*) AS rows, 9 AS columns, true AS is_active, true AS is_cleaned,
        2 AS actions_count FROM customer UNION ALL
        SELECT 'Who_Bought', COUNT(*), 6, false, false, 0 FROM orders""",
    ),
    "json_round_trip": (
        json_round_trip,
        """SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value,
        event_type FROM events""",
    ),
    "json_safe_nested": (
        json_safe_nested,
        """SELECT event_id, value AS a0, CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS a1,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS sx FROM events""",
    ),
    "inferred_types": (
        inferred_types,
        """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value, event_id % 2 = 0 AS even,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS event_type FROM events""",
    ),
    "sniff_delimiters": (
        delimiters,
        """SELECT c_mktsegment AS file, 'utf-8' AS encoding,
        [',', ';', chr(9), '|'][CAST(length(c_mktsegment) % 4 + 1 AS INT)] AS delimiter,
        false AS multi_line, COUNT(*) AS lines FROM customer GROUP BY c_mktsegment""",
    ),
    "union_same": (
        union_same,
        """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier""",
    ),
    "union_disjoint": (
        union_disjoint,
        """SELECT c_custkey AS id, c_name AS name, CAST(NULL AS INT) AS nation, NULL AS kind FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'firm' FROM supplier""",
    ),
    "union_order": (
        union_order,
        """SELECT row_number() OVER (ORDER BY t, id) - 1 AS _row_index, id, name, nation FROM (
        SELECT 0 AS t, c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer
        UNION ALL SELECT 1, s_suppkey, s_name, s_nationkey FROM supplier)""",
    ),
    "select_table": (
        selected_table, "SELECT s_suppkey AS id, s_name AS name, 'Firms of the World' AS table_name FROM supplier",
    ),
    "schema_match": (
        schema_match, "SELECT true AS same, false AS other, true AS single, COUNT(*) AS rows FROM customer",
    ),
    "table_overview": (
        table_overview,
        """SELECT 'customer' AS name, COUNT(*) AS rows, 5 AS columns, true AS is_active, false AS is_cleaned,
        0 AS actions_count FROM customer UNION ALL SELECT 'part', COUNT(*), 6, false, true, 3 FROM part""",
    ),
    "workbook_overview": (workbook_overview, _WORKBOOK),
    "table_names": (
        table_names,
        """SELECT DISTINCT o_custkey AS doc_id, CAST(year(o_orderdate) AS INT) AS page, 1 AS "table",
        'Page ' || year(o_orderdate) || ' - Table 1 (Order Key)' AS name FROM orders""",
    ),
    "grid_to_table": (grid_to_table, _GRID_ROWS),
    "grid_inspect": (grid_inspect, _GRID_INSPECT),
    "grid_export": (grid_export, _GRID_EXPORT),
    "grid_export_apart": (grid_export_apart, _GRID_APART),
    "sql_dump_load": (sql_dump_load, _DUMP),
    "sql_dump_dialects": (sql_dump_dialects, _DIALECTS),
    "sql_dump_bad_rows": (
        sql_dump_bad_rows,
        """SELECT CAST(n_nationkey AS BIGINT) AS place, 'INSERT INTO a SELECT * FROM b WHERE x = ' || chr(39) || n_name || chr(39) || ';' AS text
        FROM nation WHERE n_nationkey % 3 = 0""",
    ),
    "sql_dump_created": (sql_dump_created, "SELECT 't_' || n_nationkey AS table_name FROM nation"),
    "sql_dump_file": (
        sql_dump_file,
        """SELECT CAST(n_nationkey AS BIGINT) AS column_1, n_name AS column_2, CAST(NULL AS STRING) AS column_3,
        'nations' AS table_name FROM nation""",
    ),
    "stream_clean": (stream_clean, _STREAM),
}
