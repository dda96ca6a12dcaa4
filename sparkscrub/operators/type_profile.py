"""Semantic type of each column: e-mail, date, phone, name, numeric text, or plain."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions import text
from sparkscrub.functions.columns import (
    ROW_INDEX, col, data_columns, dtype, is_float, is_integer, is_nested, is_text, require_index,
)
from sparkscrub.functions.numbers import drop_currency, parse_double
from sparkscrub.operators.emails import VALID_EMAIL

SAMPLE_SIZE = 100
NEAR_ROWS = 1 << 16
RANGE_BITS = 12

# Words in a column's name that decide its type.
NAME_WORDS = {
    "Email": ("email", "e-mail", "mail"),
    "Date": ("date", "dob", "birth", "joined", "created", "timestamp", "time"),
    "Phone": ("contact", "phone", "mobile", "cell", "tel"),
    "Name": (
        "name", "fname", "lname", "first_name", "last_name", "full_name", "surname", "author",
        "person", "customer_name",
    ),
}

# Marks of a misspelt mail domain.
TYPO_MARKS = ("@gmai.", "@gamil.", "@gmial.", "@yaho.", "@hotmial.")

# The look of a date in digits.
DATE_SHAPE = r"^\d{1,4}[-/\.]\d{1,2}[-/\.]\d{1,4}$"


def _metrics(raw: Column) -> dict[str, Column]:
    """Aggregates over the non-null values of one column. All Columns are plain aggregates."""
    t = text.strip(raw)

    def share(hit: Column) -> Column:
        return F.avg(hit.cast("double"))

    def some(hit: Column) -> Column:
        return F.coalesce(F.bool_or(hit), F.lit(False))

    any_typo = reduce(lambda a, b: a | b, [F.lower(raw).contains(m) for m in TYPO_MARKS])
    return {
        "n": F.count(raw),
        "has_whitespace": some((raw != t) | raw.contains("  ")),
        "email_share": share(t.contains("@") & t.contains(".")),
        "email_issue": some((raw != F.lower(raw)) | raw.contains(" ") | any_typo | ~t.rlike(VALID_EMAIL)),
        "date_share": share(t.rlike(DATE_SHAPE)),
        "phone_share": share(F.length(F.regexp_replace(t, "[^0-9]+", "")) >= 7),
        "phone_noise": some(t.rlike(r"[^\d+]")),
        "name_special": some(raw.rlike(r"(?U)[^a-zA-Z\s]")),
        "name_case": some((F.length(t) > 1) & ~text.is_title_case(t)),
        "number_share": share(parse_double(drop_currency(t)).isNotNull()),
        "any_dot": some(t.contains(".")),
    }


_METRIC_NAMES = [
    "n", "has_whitespace", "email_share", "email_issue", "date_share", "phone_share", "phone_noise",
    "name_special", "name_case", "number_share", "any_dot",
]


def first_values(
    df: DataFrame, names: list[str], n: int = SAMPLE_SIZE, index: str = ROW_INDEX, near: int = NEAR_ROWS
) -> DataFrame:
    """The first ``n`` non-null values of each named column: (position, row_index, value).

    They nearly always lie among the first rows, and an index range of ``near`` holds at most
    as many rows. So that range is looked at first, and only for the columns it does not settle
    two more scans, whatever their number, find where their ``n``-th value is and read up to there.
    """
    require_index(df, index)
    place = col(index).cast("bigint")
    low, high = df.agg(F.min(place), F.max(place)).first()
    start = df if low is None else df.filter(place < low + near)
    rows = start.select(place.alias("row_index"), *[col(c).cast("string").alias(f"v{i}") for i, c in enumerate(names)])
    settled = list(range(len(names)))
    if low is not None and high >= low + near:
        counts = rows.agg(*[F.count(f"v{i}") for i in settled]).first()
        settled = [i for i in settled if counts[i] >= n]
    parts = []
    if settled:
        cells = [F.struct(F.lit(i).alias("position"), F.col(f"v{i}").alias("value")) for i in settled]
        nth = F.row_number().over(Window.partitionBy("position").orderBy("row_index"))
        values = rows.select("row_index", F.inline(F.array(*cells))).filter("value IS NOT NULL")
        parts.append(values.withColumn("nth", nth).filter(F.col("nth") <= n).select("position", "row_index", "value"))
    sparse = sorted(set(range(len(names))) - set(settled))
    if sparse:
        # One scan counts all these columns in some thousand ranges of the index, one reads up to where each has n values.
        bits = max(0, int(high - low).bit_length() - RANGE_BITS)
        ranges = df.groupBy(F.shiftright(place - low, bits).alias("r")).agg(*[F.count(col(names[i])).alias(f"n{i}") for i in sparse]).orderBy("r").collect()
        cells, last = [], low
        for i in sparse:
            seen = list(itertools.accumulate(r[f"n{i}"] for r in ranges))
            at = next((r["r"] for r, total in zip(ranges, seen) if total >= n), ranges[-1]["r"])
            end = low + ((at + 1) << bits)
            last = max(last, end)
            cells.append(F.struct(F.lit(i).alias("position"), F.when(place < end, col(names[i]).cast("string")).alias("value")))
        nth = F.row_number().over(Window.partitionBy("position").orderBy("row_index"))
        values = df.filter(place < last).select(place.alias("row_index"), F.inline(F.array(*cells))).filter("value IS NOT NULL")
        parts.append(values.withColumn("nth", nth).filter(F.col("nth") <= n).select("position", "row_index", "value"))
    return reduce(DataFrame.unionByName, parts)


def _measured(df: DataFrame, names: list[str], mode: str, index: str) -> DataFrame:
    if mode == "sample":
        return (
            first_values(df, names, index=index)
            .groupBy("position")
            .agg(*[m.alias(k) for k, m in _metrics(F.col("value")).items()])
        )
    sums, rows = [], []
    for i, name in enumerate(names):
        metrics = _metrics(col(name).cast("string"))
        sums += [m.alias(f"{k}_{i}") for k, m in metrics.items()]
        rows.append(F.struct(F.lit(i).alias("position"), *[F.col(f"{k}_{i}").alias(k) for k in metrics]))
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def _name_hits(name: str, word_match: bool) -> dict[str, bool]:
    lowered = name.lower()
    words = set("".join(ch if ch.isalnum() else " " for ch in lowered).split())

    def hit(options: tuple[str, ...]) -> bool:
        if word_match:
            return any(set(o.replace("-", " ").replace("_", " ").split()) <= words for o in options)
        return any(o in lowered for o in options)

    return {kind: hit(options) for kind, options in NAME_WORDS.items()}


def _native_type(dt: T.DataType) -> str | None:
    if is_integer(dt):
        return "Integer"
    if is_float(dt) or isinstance(dt, T.DecimalType):
        return "Float"
    if isinstance(dt, T.BooleanType):
        return "Boolean"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "Date"
    if is_nested(dt):
        return "Other"
    return None if is_text(dt) else "String"


def detect_column_types(
    df: DataFrame, mode: str = "full", word_match: bool = False, index: str = ROW_INDEX
) -> DataFrame:
    """One row per column: detected type, status, issue, suggested type, action, whitespace flag.

    ``mode="full"`` looks at all values, in one pass; ``mode="sample"`` at the first 100
    non-null values in row order, for a quick look. ``word_match`` asks for whole words in column names, so that
    ``hotel`` is no phone column.
    """
    if mode not in ("sample", "full"):
        raise ValueError("mode is 'sample' or 'full'")
    names = [n for n in data_columns(df) if n != index]
    textual = [n for n in names if _native_type(dtype(df, n)) is None]
    described = [
        (
            i, n, dtype(df, n).simpleString(), _native_type(dtype(df, n)),
            textual.index(n) if n in textual else None,
            *[_name_hits(n, word_match)[k] for k in NAME_WORDS],
        )
        for i, n in enumerate(names)
    ]
    schema = (
        "ordinal int, column string, raw_dtype string, native string, position int, "
        "named_email boolean, named_date boolean, named_phone boolean, named_name boolean"
    )
    columns = df.sparkSession.createDataFrame(described, schema)
    if textual:
        columns = columns.join(_measured(df, textual, mode, index), "position", "left")
    else:
        absent = {k: F.lit(None).cast("double" if k.endswith("share") else "boolean") for k in _METRIC_NAMES}
        columns = columns.withColumns(absent | {"n": F.lit(0)})
    return _decide(columns)


# The texts of issues, suggested types and actions, and the shares that decide, in _decide.
def _decide(columns: DataFrame) -> DataFrame:
    """The rules, first match wins; a text column without values is a plain String."""
    empty = F.coalesce(F.col("n"), F.lit(0)) == 0
    kind = (
        F.when(F.col("native").isNotNull(), F.col("native"))
        .when(empty, "String")
        .when(F.col("named_email") | (F.col("email_share") >= 0.5), "Email")
        .when(F.col("named_date") | (F.col("date_share") >= 0.5), "Date text")
        .when(F.col("named_phone") | (F.col("phone_share") >= 0.6), "Phone")
        .when(F.col("named_name"), "Name")
        .when(F.col("number_share") >= 0.7, "Number text")
        .otherwise("String")
    )
    number = F.when(F.col("any_dot"), "Float").otherwise("Integer")
    k = F.col("kind")
    untidy = (k == "String") & F.col("native").isNull() & F.col("has_whitespace")
    issue = (
        F.when((k == "Email") & F.col("email_issue"), "Email column with formatting issues, typos, or casing")
        .when(k == "Date text", "Dates stored as String")
        .when((k == "Phone") & F.col("phone_noise"), "Phone numbers with noisy symbols/spaces")
        .when(
            (k == "Name") & F.col("name_special"),
            "Name column contains special characters or digits (e.g. /, ..., _, 0-9)",
        )
        .when((k == "Name") & (F.col("has_whitespace") | F.col("name_case")), "Names with irregular whitespace or casing")
        .when(k == "Number text", F.concat(F.lit("Contains numeric values stored as text ("), number, F.lit(")")))
        .when(untidy, "Extra spaces or leading/trailing whitespace")
    )
    flagged = F.col("issue").isNotNull()
    suggested = F.when(
        flagged,
        F.when(k == "Email", "Clean Email").when(k == "Date text", "Date").when(k == "Phone", "Clean Phone")
        .when(k == "Name", "Clean Name").when(k == "Number text", number).otherwise("String"),
    )
    action = F.when(
        flagged,
        F.when(k == "Email", "Clean Email").when(k == "Date text", "Fix Date").when(k == "Phone", "Clean Contact")
        .when(k == "Name", "Clean Names").when(k == "Number text", F.concat(F.lit("Convert to "), number))
        .otherwise("Trim Spaces"),
    )
    detected = F.when(k == "Date text", "Date").when(k == "Number text", "String").otherwise(k)
    return (
        columns.withColumn("kind", kind)
        .withColumn("issue", issue)
        .select(
            F.col("ordinal").alias("position"),
            "column",
            "raw_dtype",
            detected.alias("detected_type"),
            F.when(flagged, "⚠").otherwise("✓").alias("status"),
            "issue",
            suggested.alias("suggested_type"),
            action.alias("action"),
            F.coalesce("has_whitespace", F.lit(False)).alias("has_whitespace"),
        )
    )
