"""Input tables: the given ones, and dirty views derived from them.

The given tables are clean, so dirt is put in by expressions that mean the same in Spark
and in the checking engine. Every view keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscrub.sources.readers import spread

PEOPLE = {
    "customer_id": "c_custkey",
    "name": """CASE c_custkey % 5
        WHEN 0 THEN '  ' || c_name || '  '
        WHEN 1 THEN '/' || lower(c_name)
        WHEN 2 THEN '...' || c_name || '_'
        WHEN 3 THEN 'mary_jane  o''neil-smith'
        ELSE c_name END""",
    "surname": """CASE c_custkey % 4
        WHEN 0 THEN '/' || lower(c_mktsegment)
        WHEN 1 THEN '...' || c_mktsegment || '_'
        WHEN 2 THEN '  mc-' || lower(c_mktsegment) || '  jr'
        ELSE c_mktsegment END""",
    "contact": """CASE c_custkey % 7
        WHEN 0 THEN '+91-98765-' || lpad(CAST(c_custkey AS STRING), 5, '0')
        WHEN 1 THEN '098765' || lpad(CAST(c_custkey AS STRING), 5, '0')
        WHEN 2 THEN '98abc' || CAST(c_custkey AS STRING)
        WHEN 3 THEN 'not-a-number'
        WHEN 4 THEN NULL
        ELSE '98765 ' || lpad(CAST(c_custkey AS STRING), 5, '0') END""",
    "email": """CASE c_custkey % 6
        WHEN 0 THEN 'User' || CAST(c_custkey AS STRING) || '@GMAI.COM'
        WHEN 1 THEN ' user' || CAST(c_custkey AS STRING) || ' @yahooo.com'
        WHEN 2 THEN 'user' || CAST(c_custkey AS STRING) || '@invalid-email'
        WHEN 3 THEN 'invalid-mail'
        WHEN 4 THEN 'N/A'
        ELSE 'user' || CAST(c_custkey AS STRING) || '@example.com' END""",
    "city": """CASE c_custkey % 8
        WHEN 0 THEN ''
        WHEN 1 THEN '   '
        WHEN 2 THEN 'N/A'
        WHEN 3 THEN 'unknown'
        WHEN 4 THEN NULL
        ELSE ' ' || lower(c_mktsegment) || '  town ' END""",
    "joined": """CASE c_custkey % 4
        WHEN 0 THEN '2024-05-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')
        WHEN 1 THEN lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || '/05/2024'
        WHEN 2 THEN 'May ' || CAST(1 + c_custkey % 28 AS STRING) || ' 2024'
        ELSE '' END""",
    "salary": """CASE c_custkey % 4
        WHEN 0 THEN '₹' || CAST(abs(c_custkey * 7 % 90) AS STRING) || ',500'
        WHEN 1 THEN CAST(c_custkey * 10 AS STRING)
        WHEN 2 THEN CAST(c_custkey AS STRING) || '.50'
        ELSE 'unknown' END""",
    "is_active": """CASE c_custkey % 6
        WHEN 0 THEN 'yes' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1'
        WHEN 3 THEN ' n ' WHEN 4 THEN 'maybe' ELSE NULL END""",
}

# Some customers come twice, like rows of a file that was loaded once too often.
_TWICE = "CASE WHEN c_custkey % 10 = 0 THEN {two} ELSE {one} END"

ORDER_DATES = {
    0: ("yyyy-MM-dd", "%Y-%m-%d"),
    1: ("dd/MM/yyyy", "%d/%m/%Y"),
    2: ("dd-MM-yyyy", "%d-%m-%Y"),
    3: ("MMM dd yyyy", "%b %d %Y"),
    6: ("d MMM yyyy '3pm'", "%-d %b %Y 3pm"),
    7: ("ddMMMyyyy", "%d%b%Y"),
    8: ("yyyyMMdd'T030405'", "%Y%m%dT030405"),
    9: ("yyyy MM dd", "%Y %m %d"),
}

READINGS = {
    "event_id": "event_id",
    "user_id": "user_id",
    "event_type": "CASE WHEN event_id % 11 = 0 THEN '  ' ELSE event_type END",
    "value": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END",
    "level": "CASE WHEN event_id % 4 = 1 THEN NULL ELSE CAST(user_id % 9 AS INT) END",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _select(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in exprs.items()]


def people(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "customer")).selectExpr("c_custkey AS _row_index", *_select(PEOPLE))


PEOPLE_SQL = f"people AS (SELECT c_custkey AS _row_index, {', '.join(_select(PEOPLE))} FROM customer)"


def crowd(spark: SparkSession, sf: str) -> DataFrame:
    """People with some rows repeated."""
    copies = f"explode({_TWICE.format(two='array(0, 1)', one='array(0)')}) AS copy"
    rows = table(spark, sf, "customer").selectExpr("*", copies)
    return rows.selectExpr("c_custkey * 2 + copy AS _row_index", *_select(PEOPLE))


CROWD_SQL = (
    f"crowd AS (SELECT c_custkey * 2 + copy AS _row_index, {', '.join(_select(PEOPLE))} FROM "
    f"(SELECT *, unnest({_TWICE.format(two='[0, 1]', one='[0]')}) AS copy FROM customer))"
)


# Words that begin with or hold the letters of a month, and are none.
JUNK_DATES = ("Junk 5 2024", "Market 12 2024", "Mayor 1 2024", "12 decoys 2023", "Decimal 10 20", "not a date", "2020-13-05")


def order_dates(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.lit(False), "")
    kind = F.col("o_orderkey") % 12
    for k, (pattern, _) in ORDER_DATES.items():
        text = text.when(kind == k, F.date_format("o_orderdate", pattern))
    junk = F.element_at(F.array(*[F.lit(w) for w in JUNK_DATES]), (F.col("o_custkey") % 7).cast("int") + 1)
    text = text.when(kind.isin(4, 10), junk)
    return spread(table(spark, sf, "orders")).select(F.col("o_orderkey").alias("_row_index"), text.alias("placed"))


ORDER_DATES_SQL = (
    "order_dates AS (SELECT o_orderkey AS _row_index, o_orderdate, CASE o_orderkey % 12 "
    + " ".join(f"WHEN {k} THEN strftime(o_orderdate, '{f}')" for k, (_, f) in ORDER_DATES.items())
    + "".join(f" WHEN {k} THEN {list(JUNK_DATES)}[o_custkey % 7 + 1]" for k in (4, 10)) + " ELSE NULL END AS placed FROM orders)"
)


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Events with gaps."""
    return table(spark, sf, "events").selectExpr("event_id AS _row_index", *_select(READINGS))


READINGS_SQL = f"readings AS (SELECT event_id AS _row_index, {', '.join(_select(READINGS))} FROM events)"


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Who did what: a projection of the events in which whole rows repeat."""
    return table(spark, sf, "events").selectExpr("event_id AS _row_index", "user_id", "event_type")


VISITS_SQL = "visits AS (SELECT event_id AS _row_index, user_id, event_type FROM events)"


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).selectExpr("doc_id AS _row_index", "text", "lang", "source", "n_chars")


TEXTS_SQL = "texts AS (SELECT doc_id AS _row_index, text, lang, source, n_chars FROM documents)"


def grid(spark: SparkSession, sf: str, doc: str = "o_custkey") -> DataFrame:
    """Orders as extracted table cells: a document per customer (or all in one, by ``doc``), a
    page per year, header rows included."""
    orders = spread(table(spark, sf, "orders"))
    keys = [F.expr(doc).alias("doc_id"), F.year("o_orderdate").alias("page"), F.lit(1).alias("table")]
    head = F.array(*[F.lit(h) for h in ("Order\nKey", "Status (code) ", "Price", "", "Price")])
    heads = orders.select(*keys).distinct().select("*", F.lit(0).cast("bigint").alias("row_no"), head.alias("cells"))
    price = F.col("o_totalprice").cast("bigint").cast("string")
    cells = F.when(
        F.col("o_orderkey") % 4 == 0,
        F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit("  "), "o_orderstatus", F.lit("\n"))),
    ).otherwise(
        F.array(
            F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), price,
            F.regexp_replace("o_orderpriority", "-", " - "), F.lit("  "), F.lit("extra"),
        )
    )
    body = orders.select(*keys, (F.col("o_orderkey") + 1).alias("row_no"), cells.alias("cells"))
    return heads.unionByName(body)


DUMP_HEADS = (
    "INSERT INTO `people`", "INSERT IGNORE INTO people", "INSERT INTO main.people",
    "/* it's\n'INSERT INTO x VALUES (1);' */ REPLACE INTO `db`.`people`", "-- don't\nINSERT INTO people",
)


def dump_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as the lines of a SQL dump (file, place, text).

    Each statement holds two tuples on lines of their own, the second of them short. Some
    names hold a quote, a semicolon and a line break; some heads fill two lines; some quotes are
    escaped by a backslash; some heads are qualified or say IGNORE; comments hold quotes and code.
    """
    key = F.col("c_custkey").cast("string")
    name = (
        F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("O''Neil;\n-- "), "c_name"))
        .when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("O\\'Hara \\\\"), "c_name"))
        .otherwise(F.col("c_name"))
    )
    verb = F.element_at(F.array(*[F.lit(v) for v in DUMP_HEADS]), (F.col("c_custkey") % len(DUMP_HEADS)).cast("int") + 1)
    segment = F.when(F.col("c_custkey") % 5 == 0, F.lit("NULL")).otherwise(
        F.concat(F.lit("'"), "c_mktsegment", F.lit("'"))
    )
    gap = F.when(F.col("c_custkey") % 3 == 0, F.lit("\n")).otherwise(F.lit(" "))
    statement = F.concat(
        verb, F.lit(" (id, name, segment, score)"), gap, F.lit("VALUES\n("), key, F.lit(", '"), name,
        F.lit("', "), segment, F.lit(", "), F.col("c_nationkey").cast("string"), F.lit(".5),\n(-"), key,
        F.lit(", 'twin, of ("), key, F.lit(")');"),
    )
    lines = table(spark, sf, "customer").select("c_custkey", F.posexplode(F.split(statement, "\n")))
    return lines.select(
        F.lit("dump.sql").alias("file"), (F.col("c_custkey") * 8 + F.col("pos")).alias("place"),
        F.col("col").alias("text"),
    )
