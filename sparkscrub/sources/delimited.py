"""Delimited text: encoding and delimiter per file, NA tokens, typed columns, bad rows aside."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions.columns import ROW_INDEX, col, data_columns, dtype, is_text
from sparkscrub.functions.numbers import parse_double, parse_long
from sparkscrub.operators.ordered_fill import ordered_fill
from sparkscrub.operators.running import running_total
from sparkscrub.session import written_table
from sparkscrub.sources.rowid import PLACE_BITS, text_place, with_file_index

DELIMITERS = (",", ";", "\t", "|")

# Texts a reader takes for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_WHOLE = r"^\s*[+-]?\d+\s*$"
_TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")
_BAD = "_bad_row"
# cp1252 differs from ISO-8859-1, which Spark can read, in these characters only.
_LATIN = "".join(chr(i) for i in range(0x80, 0xA0))
_WESTERN = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")
_BOM = "﻿"


def _to_western(c: Column) -> Column:
    return F.translate(c, _LATIN, _WESTERN)


def _count(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def _ends_open(line: Column, delimiter: str) -> Column:
    """Whether a quoted field is open at the end of a line that begins outside quotes. A quote opens a field only
    where the field begins; elsewhere it is a character."""
    d = re.escape(delimiter)
    quoted = r'"(?:[^"]++|"")*+'
    field = rf'(?:{quoted}"[^{d}]*+|[^"{d}][^{d}]*+)?+'
    return F.contains(line, F.lit('"')) & line.rlike(rf"(?s)^(?:{field}{d})*+{quoted}$")


def _unquoted(line: Column) -> Column:
    return F.regexp_replace(line, '"[^"]*"', "")


def sniff(lines: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Encoding and delimiter of every file, from all of its lines (file, place, line).

    UTF-8 if every line is, else cp1252. The delimiter is the one whose count per line
    agrees over the most lines; then the one that occurs most; then a comma. ``heads`` may
    hold fewer lines, the first of each file among them, to find the headers in.
    """
    cleaned = _unquoted(F.col("line"))
    marks = [F.struct(F.lit(i).alias("d"), _count(cleaned, d).alias("k"), _ends_open(F.col("line"), d).alias("open_quote"))
             for i, d in enumerate(DELIMITERS)]
    per_line = lines.filter(F.length("line") > 0).select(
        "file",
        F.is_valid_utf8("line").alias("utf8"),
        F.inline(F.array(*marks)),
    )
    # Only numbers and flags are aggregated here, so every step hashes and combines map-side.
    agreeing = per_line.groupBy("file", "d", "k").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("utf8").alias("utf8"), F.bool_or("open_quote").alias("open_quote")
    )
    of_delimiter = agreeing.groupBy("file", "d").agg(
        F.max(F.when(F.col("k") > 0, F.struct("n", "k"))).alias("best"),
        F.sum(F.col("n") * F.col("k")).alias("total"),
        F.sum("n").alias("lines"),
        F.bool_and("utf8").alias("utf8"),
        F.bool_or("open_quote").alias("open_quote"),
    )
    rank = F.struct(
        F.coalesce(F.col("best.n"), F.lit(0)), F.coalesce(F.col("best.k"), F.lit(0)), F.col("total"), -F.col("d")
    )
    per_file = of_delimiter.groupBy("file").agg(
        F.max_by("d", rank).alias("d"),
        F.max("lines").alias("lines"),
        F.bool_and("utf8").alias("utf8"),
        F.max_by("open_quote", rank).alias("multi_line"),
    )
    heads = (lines if heads is None else heads).filter(F.length("line") > 0)
    starts = heads.groupBy("file").agg(F.min("place").alias("place"))
    old = _to_western(F.decode(F.col("line").cast("binary"), "ISO-8859-1"))
    header = F.when(F.is_valid_utf8("line"), F.col("line")).otherwise(old)
    headers = heads.join(starts, ["file", "place"]).select(
        "file", F.regexp_replace(header, f"^{_BOM}|\\r$", "").alias("header")
    )
    return per_file.join(headers, "file").select(
        "file",
        F.when(F.col("utf8"), "utf-8").otherwise("cp1252").alias("encoding"),
        F.element_at(F.array(*[F.lit(d) for d in DELIMITERS]), F.col("d") + 1).alias("delimiter"),
        "header",
        "multi_line",
        "lines",
    )


def sniff_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.text(paths)
    columns = [F.col("_metadata.file_path").alias("file"), text_place().alias("place"), F.col("value").alias("line")]
    first_block = F.col("_metadata.file_block_start") == 0
    heads = raw.select(*columns, first_block.alias("head")).filter("head").drop("head")
    return sniff(raw.select(*columns), heads)


def na_to_null(df: DataFrame) -> DataFrame:
    """NA tokens become null in every text column."""
    names = [n for n in data_columns(df) if is_text(dtype(df, n))]
    return df.withColumns({n: F.when(~col(n).isin(*NA_TOKENS), col(n)) for n in names})


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest type all their values fit: BIGINT, DOUBLE, BOOLEAN, text.

    One aggregation over all columns. A whole-number column with nulls stays BIGINT.
    """
    names = [n for n in data_columns(df) if is_text(dtype(df, n))]
    if not names:
        return df
    sums = []
    for i, n in enumerate(names):
        c = col(n)
        sums += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.rlike(_WHOLE) & parse_long(c).isNotNull()).alias(f"l{i}"),
            F.count_if(parse_double(c).isNotNull()).alias(f"d{i}"),
            F.count_if(c.isin(*_TRUTH)).alias(f"b{i}"),
        ]
    seen = df.agg(*sums).first()
    typed = {}
    for i, n in enumerate(names):
        rows = seen[f"n{i}"]
        if rows and seen[f"l{i}"] == rows:
            typed[n] = parse_long(col(n))
        elif rows and seen[f"d{i}"] == rows:
            typed[n] = parse_double(col(n))
        elif rows and seen[f"b{i}"] == rows:
            typed[n] = col(n).try_cast("boolean")
    return df.withColumns(typed) if typed else df


@dataclass(frozen=True)
class Delimited:
    data: DataFrame
    bad_rows: DataFrame
    """(file, row index, text) of the rows with more fields than the header."""
    formats: list[dict]
    """Encoding, delimiter and files of each group of like files."""


def _read_group(
    spark: SparkSession, all_files: list[str], files: list[str], header: str, delimiter: str, encoding: str,
    multi_line: bool,
) -> tuple[DataFrame, DataFrame]:
    names = header_names(spark, header, delimiter)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BAD]])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "enforceSchema": "true"}
    if multi_line:
        records = _records(spark, files, all_files, delimiter, encoding)
        cells = F.from_csv("text", schema.toDDL(), options)
        plain = F.from_csv("text", schema.toDDL(), {**options, "quote": "\u0000"})
        raw = records.select(ROW_INDEX, F.when(F.col("cut"), plain).otherwise(cells).alias("cells")).select(ROW_INDEX, "cells.*")
    else:
        reader = spark.read.schema(schema).options(
            header=True, encoding="ISO-8859-1" if encoding == "cp1252" else encoding, columnPruning=False, **options)
        raw = with_file_index(reader.csv(files), text_place(), all_files)
        if encoding == "cp1252":
            raw = raw.withColumns({n: _to_western(col(n)) for n in names})
    fields = _count(_unquoted(col(_BAD)), delimiter) + 1
    # The reader refuses a query that needs the bad-row column alone, such as a count; the
    # second, always true condition makes every query need a data column too.
    too_long = F.coalesce(fields > len(names), F.lit(False)) & (F.coalesce(F.length(col(names[0])), F.lit(0)) >= 0)
    data = raw.filter(~too_long).select(ROW_INDEX, *[col(n) for n in names])
    bad = raw.filter(too_long).select(ROW_INDEX, F.col(_BAD).alias("text"))
    return data, bad


def _records(spark: SparkSession, files: list[str], all_files: list[str], delimiter: str, encoding: str) -> DataFrame:
    """(index, text, cut) of the records of files in which fields run over lines, without their headers.

    The files are split as any others. A line is a function of whether it begins in a quoted field: it
    changes nothing, always ends outside or inside, or turns one into the other. Put together along the
    file, by running totals of turns since the last line of a fixed end, they give each line's state;
    only lines of records that are open somewhere are joined. A quote that is still open at the end of its
    file is a character: its record is its first line (``cut``), and the following lines are their own.
    """
    raw = with_file_index(spark.read.option("lineSep", "\n").text(files), text_place(), all_files)
    value = _to_western(F.decode(F.col("value").cast("binary"), "ISO-8859-1")) if encoding == "cp1252" else F.col("value")
    lines = raw.select(ROW_INDEX, F.shiftright(ROW_INDEX, PLACE_BITS).alias("rank"), F.regexp_replace(value, rf"^{_BOM}|\r$", "").alias("line"))
    starts = lines.groupBy("rank").agg(F.min(ROW_INDEX).alias("begins"), F.min(F.when(F.col("line") != "", F.col(ROW_INDEX))).alias("header"))
    lines = lines.join(written_table(starts, "csv-starts"), "rank").select(
        ROW_INDEX, "line", (F.col(ROW_INDEX) == F.col("begins")).alias("first"), (F.col(ROW_INDEX) == F.col("header")).alias("header"))
    out, in_ = _ends_open(F.col("line"), delimiter), ~F.contains("line", F.lit('"')) | _ends_open(F.concat(F.lit('"'), "line"), delimiter)
    lines = written_table(lines.withColumn("out", out).withColumn("in", in_ & (~F.col("first") | F.col("out"))), "csv-lines")
    # of a line that is no turn, the end is fixed or as its beginning
    turns = lines.where("out OR NOT `in` OR first").select(
        ROW_INDEX, (F.col("out") & ~F.col("in")).cast("int").alias("turn"), F.when(F.col("out") == F.col("in"), F.col("in").cast("int")).alias("fixed"))
    turned = written_table(running_total(turns, F.col("turn"), "turned"), "csv-turns")
    anchors = turned.withColumn("anchor", F.pmod(F.col("fixed") + F.col("turned"), F.lit(2)))
    ends = ordered_fill(anchors, ["anchor"]).select(
        ROW_INDEX, F.pmod(F.coalesce("anchor", F.lit(0)) + F.col("turned") + F.col("turn"), F.lit(2)).alias("end"))
    known = lines.select(ROW_INDEX, "first").join(ends, ROW_INDEX, "left")
    begun = ordered_fill(known.withColumn("begin", F.col("end")), ["begin"], own=False)
    state = written_table(begun.select(
        ROW_INDEX, F.when(F.col("first"), 0).otherwise(F.coalesce("begin", F.lit(0))).alias("begin"), F.coalesce("end", "begin", F.lit(0)).alias("end")).where("begin = 1 OR end = 1"), "csv-open")
    single = lines.join(state, ROW_INDEX, "left_anti").select(ROW_INDEX, "line", "header", F.lit(False).alias("cut"))
    starts = ordered_fill(state.withColumn("start", F.when(F.col("begin") == 0, col(ROW_INDEX))), ["start"]).select(ROW_INDEX, "start", "end")
    runs = lines.join(starts, ROW_INDEX).groupBy("start").agg(
        F.array_sort(F.collect_list(F.struct(ROW_INDEX, "line"))).alias("l"), F.max_by("end", ROW_INDEX).alias("end"), F.bool_or("header").alias("header"))
    whole = runs.where("end = 0").select(F.col("start").alias(ROW_INDEX), F.array_join("l.line", "\n").alias("line"), "header", F.lit(False).alias("cut"))
    left = runs.where("end = 1").select("start", "header", F.inline("l")).select(
        ROW_INDEX, "line", (F.col("header") & (F.col(ROW_INDEX) == F.col("start"))).alias("header"), (F.col(ROW_INDEX) == F.col("start")).alias("cut"))
    records = single.unionByName(whole).unionByName(left).where("NOT header AND line <> ''")
    return records.select(ROW_INDEX, F.col("line").alias("text"), "cut")


def header_names(spark: SparkSession, header: str, delimiter: str) -> list[str]:
    """Column names in a header line: empty ones become ``Unnamed: i``, repeats ``name.1``."""
    width = re.sub('"[^"]*"', "", header).count(delimiter) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    line = spark.range(1).select(F.lit(header).alias("line"))
    cells = line.select(F.from_csv("line", F.lit(schema), {"sep": delimiter, "escape": '"'}).alias("f")).first()["f"]
    names: list[str] = []
    seen: dict[str, int] = {}
    for i, cell in enumerate(cells):
        name = cell if cell and cell.strip() else f"Unnamed: {i}"
        seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{seen[name]}" if seen[name] else name)
    return names


def read_delimited(
    spark: SparkSession,
    paths: str | list[str],
    delimiter: str | None = None,
    encoding: str | None = None,
    infer: bool = True,
) -> Delimited:
    """Read delimited files with a header row; files of different make-up are unioned by name.

    Files are split, also where quoted fields run over lines: only the lines of such records are joined.
    """
    groups: dict[tuple, list[str]] = {}
    for f in sniff_files(spark, paths).collect():
        key = (f["header"], delimiter or f["delimiter"], encoding or f["encoding"], f["multi_line"])
        groups.setdefault(key, []).append(f["file"])
    if not groups:
        raise ValueError(f"no lines in {paths}")
    order = sorted(groups.items(), key=lambda g: min(g[1]))
    every = [f for _, files in order for f in files]
    parts = [_read_group(spark, every, sorted(files), *key) for key, files in order]
    data = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d for d, _ in parts])
    bad = reduce(DataFrame.unionByName, [b for _, b in parts])
    data = na_to_null(data)
    if infer:
        data = infer_types(data)
    formats = [{"delimiter": k[1], "encoding": k[2], "multi_line": k[3], "files": sorted(v)} for k, v in order]
    return Delimited(data, bad, formats)
