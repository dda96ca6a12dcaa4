"""SQL dump text: the rows of its INSERT statements as tables.

The text is cut into statements in parallel (``dumptext``), also where one statement fills a file of any
size: it is cut between its tuples, and the head that a tuple belongs to is carried down from where it
stands. Whether a backslash escapes is told for each file by its quotes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkscrub.functions.columns import ROW_INDEX
from sparkscrub.functions.text import strip
from sparkscrub.operators.running import dense_index
from sparkscrub.session import written_table
from sparkscrub.sources.dumptext import statements
from sparkscrub.sources.rowid import PLACE_BITS, text_place

# Grammar: a quoted text ends at its quote, unless that is doubled or, where that counts, stands behind a backslash.
_QUOTED = r"""'(?:[^'\\]++|\\[\s\S]|'')*+'|"(?:[^"\\]++|\\[\s\S]|"")*+\"""", r"""'(?:[^']++|'')*+'|"(?:[^"]++|"")*+\""""
_NAME = r"[`\"'\[]?([a-zA-Z0-9_$]+)[`\"'\]]?"
_ANY_NAME = _NAME.replace("([a", "(?:[a")
_VERB = r"\b(?:INSERT|REPLACE)\s+(?:(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY|IGNORE|OR\s+\w+)\s+)*INTO\s+"
_HEAD = _VERB + rf"(?:{_ANY_NAME}\s*\.\s*)*" + _NAME + r"\s*(?:\(([^()]*)\))?\s*(?:OVERRIDING\s+\w+\s+VALUE\s+)?VALUES?"
_ANY_HEAD = _HEAD.replace(_NAME, _ANY_NAME).replace("([^()]*)", "(?:[^()]*)")
_CREATE = rf"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:{_ANY_NAME}\s*\.\s*)*" + _NAME
# What follows the tuples of a statement holds none, though it may have parentheses.
_REST = r"\bON\s+(?:DUPLICATE\s+KEY|CONFLICT)\b"


def _by_reading(make: Callable[[str], Column]) -> Column:
    """An expression made from the pattern of quoted texts, by the reading chosen for the file."""
    return F.when(F.col("standard"), make(_QUOTED[1])).otherwise(make(_QUOTED[0]))


def _tokens(quoted: str) -> Column:
    tuple_ = rf"\((?:{quoted}|[^()'\"]++|\([^()]*+\))*+\)"
    # Quoted text outside tuples is a token too, so that nothing inside it is taken for one.
    token = rf"(?is)({_ANY_HEAD}|{_REST}|{tuple_}|;|{quoted})"
    return F.filter(F.regexp_extract_all("text", F.lit(token), F.lit(1)), lambda t: ~F.left(t, F.lit(1)).isin("'", '"'))


def _items(quoted: str) -> Column:
    item = rf"((?:{quoted}|[^,'\"(]++|\([^()]*+\))++)"
    return F.regexp_extract_all(F.expr("substring(token, 2, length(token) - 2)"), F.lit(item), F.lit(1))


def _carried(slim: DataFrame) -> DataFrame:
    """(file, block, seq, start, above): tokens of the file ahead of a piece, and the last mark among them.

    Blocks are put in order by file, and the pieces within each block."""
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    blocks = slim.groupBy("file", "block").agg(F.sum("n").alias("n"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("seq"))).alias("mark"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(ahead), none).alias("before"), F.last("mark", True).over(ahead).alias("entering"))
    inner = slim.select("file", "block", "seq", F.coalesce(F.sum("n").over(within), none).alias("start"), F.last("mark", True).over(within).alias("above"))
    return inner.join(blocks, ["file", "block"]).select(
        "file", "block", "seq", (F.col("before") + F.col("start")).alias("start"), F.coalesce("above", "entering").alias("above"))


def _parsed(pieces: DataFrame) -> DataFrame:
    """Pieces with their tokens, the marks among these, and the head in force where each begins."""
    marks = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("i"), t.alias("mark"))), lambda m: ~m["mark"].startswith("("))
    parsed = pieces.withColumn("tokens", F.when(F.col("open"), F.array().cast("array<string>")).otherwise(_by_reading(_tokens))).withColumn("marks", marks).withColumn("n", F.size("tokens"))
    parsed = written_table(parsed.withColumn("mark", F.try_element_at("marks", F.lit(-1))["mark"]), "dump-tokens")
    return parsed.join(_carried(parsed.select("file", "block", "seq", "n", "mark")), ["file", "block", "seq"])


def dump_rows(parsed: DataFrame) -> DataFrame:
    """One row per inserted tuple: (table_name, row index, names, items).

    ``items`` are (kind, value) with kind int, float, text or null.
    """
    files = [r[0] for r in parsed.select("file").distinct().orderBy("file").collect()]
    ranks = parsed.sparkSession.createDataFrame(list(enumerate(files)), "rank bigint, file string")
    one = parsed.join(ranks, "file").select("rank", "marks", "start", "above", "standard", F.posexplode("tokens").alias("pos", "token"))
    before = F.try_element_at(F.filter("marks", lambda m: m["i"] < F.col("pos")), F.lit(-1)).getField("mark")
    headed = one.filter(F.col("token").startswith("(")).select(
        (F.shiftleft("rank", PLACE_BITS) + F.col("start") + F.col("pos")).alias(ROW_INDEX), F.coalesce(before, "above").alias("head"), "token", "standard"
    )
    rows = headed.filter(F.regexp_like("head", F.lit("(?is)^" + _VERB))).select(
        ROW_INDEX,
        F.regexp_extract("head", "(?is)" + _HEAD, 1).alias("table_name"),
        F.regexp_extract("head", "(?is)" + _HEAD, 2).alias("listed"),
        _by_reading(_items).alias("raw"), "standard",
    )
    given = F.transform(F.split("listed", ","), lambda x: F.regexp_replace(x, r"^[\s`\"']+|[\s`\"']+$", ""))
    numbered = F.transform(F.sequence(F.lit(1), F.size("raw")), lambda i: F.concat(F.lit("column_"), i.cast("string")))
    return rows.select(
        ROW_INDEX,
        "table_name",
        F.when(F.col("listed") == "", numbered).otherwise(given).alias("names"),
        F.transform(F.transform("raw", strip), lambda x: _literal(x, F.col("standard"))).alias("items"),
    )


def _literal(x: Column, standard: Column) -> Column:
    """A literal's kind and text. Quotes are taken off, doubled ones made single, escapes read where they count."""
    quote = F.left(x, F.lit(1))
    quoted = (F.length(x) >= 2) & quote.isin("'", '"') & (F.right(x, F.lit(1)) == quote)
    inner = F.substr(x, F.lit(2), F.length(x) - 2)
    single = F.when(quote == "'", F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(
        F.replace(inner, F.lit('""'), F.lit('"'))
    )
    read = F.replace(single, F.lit("\\\\"), F.lit("\u0001"))  # a doubled backslash escapes nothing after it
    for code, meant in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        read = F.replace(read, F.lit("\\" + code), F.lit(meant))
    read = F.replace(F.regexp_replace(read, r"\\(.)", "$1"), F.lit("\u0001"), F.lit("\\"))
    unescaped = F.when(~standard & F.contains(inner, F.lit("\\")), read).otherwise(single)
    kind = (
        F.when(quoted, "text")
        .when(F.upper(x) == "NULL", "null")
        .when(x.rlike(r"^[+-]?\d+$"), "int")
        .when(x.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), "float")
        .otherwise("text")
    )
    value = F.when(quoted, unescaped).when(F.upper(x) != "NULL", x)
    return F.struct(kind.alias("kind"), value.alias("value"))


@dataclass(frozen=True)
class Dump:
    rows: DataFrame
    lines: DataFrame
    bad_rows: DataFrame
    """Text that gave no row though it inserts: (file, place, text)."""

    def tables(self) -> list[str]:
        """Table names in order of first appearance; from CREATE TABLE if nothing is inserted."""
        first = self.rows.groupBy("table_name").agg(F.min(ROW_INDEX).alias("at"))
        names = [r[0] for r in first.orderBy("at").collect()]
        if names:
            return names
        created = F.explode(F.regexp_extract_all("text", F.lit(_CREATE), F.lit(1))).alias("table_name")
        return [r[0] for r in self.lines.select(created).distinct().orderBy("table_name").collect()]

    def pick(self, table: str | None) -> str:
        """The named table, or the first one."""
        names = self.tables()
        if not names:
            raise ValueError("the dump holds no table")
        return table if table in names else names[0]

    def table(self, name: str) -> DataFrame:
        """One table, typed, with a dense row index in statement order.

        A column is BIGINT or DOUBLE if all its literals are such numbers, else text.
        """
        rows = self.rows.filter(F.col("table_name") == name)
        cell = F.arrays_zip("names", F.slice("items", 1, F.size("names")).alias("items"))
        kind = F.coalesce(F.col("cell.items.kind"), F.lit("null"))
        seen = (
            rows.select(F.posexplode(cell).alias("i", "cell"))
            .groupBy(F.col("cell.names").alias("column"))
            .agg(
                F.min("i").alias("i"),
                F.bool_and(kind.isin("int", "null")).alias("whole"),
                F.bool_and(kind.isin("int", "float", "null")).alias("number"),
                F.bool_or(F.col("cell.items.value").isNotNull()).alias("any"),
            )
            .orderBy("i", "column")
            .collect()
        )

        def value(r) -> Column:
            spot = F.array_position("names", F.lit(r["column"]))
            text = F.when(spot > 0, F.try_element_at("items", F.greatest(spot, F.lit(1)).cast("int"))).getField("value")
            to = "bigint" if r["any"] and r["whole"] else "double" if r["any"] and r["number"] else "string"
            return (text if to == "string" else text.try_cast(to)).alias(r["column"])

        return dense_index(rows.select(ROW_INDEX, *[value(r) for r in seen]))


def _unread(parsed: DataFrame) -> DataFrame:
    """(file, place, text) of what inserts but gives no row, or is cut off by the end of its file."""
    bare = _by_reading(lambda quoted: F.regexp_replace("text", quoted, '"q"'))
    tuples = F.exists("tokens", lambda t: t.startswith("("))
    inserting = F.regexp_like("above", F.lit("(?is)^" + _VERB)) & F.regexp_like("bare", F.lit(r"[^\s;,]")) & (F.size("marks") - F.exists("tokens", lambda t: t == ";").cast("int") == 0)
    lost = (F.regexp_count("bare", F.lit(rf"(?is){_VERB}")) > F.regexp_count("bare", F.lit(rf"(?is){_HEAD}"))) | (
        ~tuples & (F.regexp_like("bare", F.lit(rf"(?is){_VERB}")) | F.coalesce(inserting, F.lit(False))))
    return parsed.withColumn("bare", bare).filter(lost | F.col("open")).select("file", "place", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def parse_dump(lines: DataFrame, in_order: bool = False) -> Dump:
    """A dump from its lines (file, place, text); ``in_order`` says that each partition of them is in order.

    The text is parsed once: its tuples are written to the shared folder and read from there.
    """
    parsed = _parsed(statements(lines, in_order))
    return Dump(written_table(dump_rows(parsed), "dump-rows"), lines, _unread(parsed))


def read_sql_dump(spark: SparkSession, paths: str | list[str]) -> Dump:
    raw = spark.read.text(paths)
    file = F.col("_metadata.file_path").alias("file")
    return parse_dump(raw.select(file, text_place().alias("place"), F.col("value").alias("text")), in_order=True)
