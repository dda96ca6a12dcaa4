"""Cleaners, conversions, rejects and change counts."""

from __future__ import annotations

from pyspark.sql import functions as F

import sparkscrub as ss
from sparkscrub.operators.emails import is_valid_email
from sparkscrub_queries import sql as q
from sparkscrub_queries.inputs import (
    ORDER_DATES_SQL, PEOPLE_SQL, TEXTS_SQL, order_dates, people, texts,
)

KEY = "_row_index"


def _cells(cleaners):
    """A query that cleans the named columns of people and keeps only those."""

    def run(spark, sf):
        return ss.clean(people(spark, sf), cleaners).select(KEY, *cleaners)

    return run


def _people(body: str) -> str:
    return q.with_(PEOPLE_SQL, body)


def email_validity(spark, sf):
    """How many addresses are valid after cleaning: the smallest whole job."""
    cleaned = ss.clean(people(spark, sf), {"email": ss.email_cleaner()})
    valid = F.coalesce(is_valid_email(F.col("email")), F.lit(False))
    return cleaned.groupBy(valid.alias("email_valid")).agg(
        F.count(F.lit(1)).alias("people"), F.count_distinct("email").alias("addresses")
    )


def _reasons(spark, sf, column, cleaner, table=people):
    return ss.rejects(table(spark, sf), column, cleaner)


_REJECTED_EMAIL = f"""SELECT _row_index AS row_index, email AS original, cleaned, CASE
    WHEN NOT contains(cleaned, '@') THEN 'Missing ''@'' symbol'
    WHEN NOT contains(split_part(cleaned, '@', -1), '.') THEN 'Missing domain extension (e.g. .com)'
    ELSE 'Invalid email characters/syntax' END AS reason
    FROM (SELECT *, {q.email('email')} AS cleaned FROM people)
    WHERE lower(email) NOT IN ('', 'nan', 'null', 'none', 'n/a') AND NOT regexp_matches(cleaned, '{q.VALID_EMAIL}')"""


def contact_styles(spark, sf):
    base = people(spark, sf).select(
        KEY, F.col("contact").alias("hyphenated"), F.col("contact").alias("international"),
        F.col("contact").alias("raw_digits"),
    )
    return ss.clean(
        base,
        {
            "hyphenated": ss.contact_cleaner(normalize_10_digits=True, format_style="hyphenated"),
            "international": ss.contact_cleaner(format_style="international"),
            "raw_digits": ss.contact_cleaner(),
        },
    )


def _order_dates(fmt_options):
    def run(spark, sf):
        return ss.clean(order_dates(spark, sf), {"placed": ss.date_cleaner(**fmt_options)})

    return run


def _order_dates_sql(fmt):
    cleaned = f"CASE WHEN {q.date('placed')} IS NULL THEN placed ELSE strftime({q.date('placed')}, '{fmt}') END"
    return q.with_(ORDER_DATES_SQL, f"SELECT _row_index, {cleaned} AS placed FROM order_dates")


def as_real_dates(spark, sf):
    return ss.clean(order_dates(spark, sf), {"placed": ss.date_cleaner(as_date=True)})


def converted(column, target, **options):
    return _cells({column: ss.type_converter(target, **options)})


def convert_rejects(spark, sf):
    rows = people(spark, sf)
    parts = [("salary", "Float"), ("is_active", "Boolean"), ("joined", "Date")]
    out = None
    for column, target in parts:
        one = ss.rejects(rows, column, ss.type_converter(target)).select(
            F.lit(column).alias("column"), "row_index", "original", "reason"
        )
        out = one if out is None else out.unionByName(one)
    return out


_CONVERT_REJECTS = _people(
    f"""SELECT 'salary' AS "column", _row_index AS row_index, salary AS original,
        'Non-numeric characters present' AS reason FROM people WHERE {q.number('salary')} IS NULL
    UNION ALL SELECT 'is_active', _row_index, is_active, 'Cannot be evaluated as true/false' FROM people
        WHERE lower(trim(is_active)) NOT IN ('true','1','yes','y','t','false','0','no','n','f')
    UNION ALL SELECT 'joined', _row_index, joined, 'Invalid or unparseable date format' FROM people
        WHERE {q.date('joined')} IS NULL"""
)

_TRUTH = """CASE WHEN lower(trim(is_active)) IN ('true','1','yes','y','t') THEN true
    WHEN lower(trim(is_active)) IN ('false','0','no','n','f') THEN false END"""


def change_counts(spark, sf):
    return ss.count_changes(
        people(spark, sf),
        {
            "name": ss.name_cleaner(),
            "contact": ss.contact_cleaner(normalize_10_digits=True),
            "email": ss.email_cleaner(),
            "city": ss.string_cleaner(),
            "joined": ss.date_cleaner(),
            "salary": ss.type_converter("Float"),
        },
    )


def _count(column, changed, rejected="0"):
    return (
        f"SELECT '{column}' AS \"column\", COUNT(*) AS rows, "
        f"CAST(COUNT(CASE WHEN {changed} THEN 1 END) AS BIGINT) AS cells_changed, "
        f"CAST(COUNT(CASE WHEN {rejected} = 1 THEN 1 END) AS BIGINT) AS cells_rejected FROM people"
    )


_LEN = f"length({q.ten_digits('contact')})"
_BAD_MAIL = (
    f"CASE WHEN lower(email) NOT IN ('', 'nan', 'null', 'none', 'n/a') AND "
    f"NOT regexp_matches({q.email('email')}, '{q.VALID_EMAIL}') THEN 1 ELSE 0 END"
)
_CITY = q.no_blank(q.squeeze("city"))
_CHANGE_COUNTS = _people(
    " UNION ALL ".join(
        [
            _count("name", f"name IS DISTINCT FROM {q.name('name')}"),
            _count(
                "contact", f"contact IS DISTINCT FROM ({q.ten_digits('contact')})",
                f"CASE WHEN {_LEN} > 0 AND ({_LEN} < 7 OR {_LEN} > 15) THEN 1 ELSE 0 END",
            ),
            _count("email", f"email IS DISTINCT FROM ({q.email('email')})", _BAD_MAIL),
            _count("city", f"city IS DISTINCT FROM ({_CITY})"),
            _count("joined", f"strftime({q.date('joined')}, '%Y-%m-%d') <> joined"),
            _count(
                "salary", f"{q.number('salary')} IS NOT NULL",
                f"CASE WHEN salary IS NOT NULL AND {q.number('salary')} IS NULL THEN 1 ELSE 0 END",
            ),
        ]
    )
)


def empty_to_null(spark, sf):
    return ss.replace_empty_with_null(people(spark, sf), ["city", "email", "salary"]).select(
        KEY, "city", "email", "salary"
    )


def empty_to_null_no_placeholders(spark, sf):
    return ss.replace_empty_with_null(
        people(spark, sf), ["city", "salary"], include_placeholders=False, custom_placeholders=["building  town"]
    ).select(KEY, "city", "salary")


def empty_to_null_exact(spark, sf):
    return ss.replace_empty_with_null(people(spark, sf), ["city"], include_whitespace=False).select(KEY, "city")


def quick_fix(spark, sf):
    """The fix each column's profile finding asks for, for the whole table at once."""
    rows = people(spark, sf)
    found = ss.detect_column_types(rows).orderBy("position").collect()
    cleaners = {}
    for t in found:
        if t["raw_dtype"] == "string":
            step = ss.quick_fix(t["column"], t["detected_type"], t["action"])
            cleaners |= step.cleaners(rows, KEY)
    return ss.clean(rows, cleaners)


_QUICK_FIX = _people(
    f"""SELECT _row_index, customer_id, {q.ten_digits('name')} AS name, {q.name('surname')} AS surname,
    {q.ten_digits('contact')} AS contact, {q.email('email')} AS email, {_CITY} AS city, strftime({q.date('joined')}, '%Y-%m-%d') AS joined,
    {q.number('salary')} AS salary, {q.no_blank(q.squeeze('is_active'))} AS is_active FROM people"""
)


def clean_document_text(spark, sf):
    """The text cleaner over whole documents, and a custom replacement."""
    cleaned = ss.clean(
        texts(spark, sf),
        {
            "text": ss.string_cleaner(custom_regex_replace=("([0-9]+)", "<$1>"), case_transform="lower"),
            "lang": ss.string_cleaner(case_transform="capitalize", remove_special_chars=True),
        },
    )
    return cleaned.select(KEY, F.md5("text").alias("text_hash"), F.length("text").alias("n_chars"), "lang")


_DOCUMENT_TEXT = """regexp_replace(lower(regexp_replace(regexp_replace(text,
    '^[\\s\\x{0b}\\x{85}\\p{Z}]+|[\\s\\x{0b}\\x{85}\\p{Z}]+$', '', 'g'),
    '[\\s\\x{0b}\\x{85}\\p{Z}]+', ' ', 'g')), '([0-9]+)', '<\\1>', 'g')"""


QUERIES = {
    "email_validity": (
        email_validity,
        _people(
            f"""SELECT email_valid, COUNT(*) AS people, COUNT(DISTINCT email) AS addresses FROM
            (SELECT {q.email('email')} AS email, regexp_matches({q.email('email')}, '{q.VALID_EMAIL}') AS email_valid
             FROM people) GROUP BY email_valid"""
        ),
    ),
    "clean_strings": (
        _cells(
            {
                "city": ss.string_cleaner(case_transform="title"),
                "name": ss.string_cleaner(remove_special_chars=True, case_transform="upper"),
                "is_active": ss.string_cleaner(trim_whitespace=False, empty_to_null=False),
            }
        ),
        _people(
            f"""SELECT _row_index, {q.no_blank(q.title(q.squeeze('city')))} AS city,
            regexp_replace(upper({q.squeeze('name')}), '[^a-zA-Z0-9\\s\\-_\\.]', '', 'g') AS name,
            is_active FROM people"""
        ),
    ),
    "clean_all_strings": (
        lambda spark, sf: ss.clean_all_strings(people(spark, sf)),
        _people(
            "SELECT _row_index, customer_id, "
            + ", ".join(
                f"{q.no_blank(q.squeeze(c))} AS {c}"
                for c in ("name", "surname", "contact", "email", "city", "joined", "salary", "is_active")
            )
            + " FROM people"
        ),
    ),
    "clean_document_text": (
        clean_document_text,
        q.with_(
            TEXTS_SQL,
            f"""SELECT _row_index, md5({_DOCUMENT_TEXT}) AS text_hash, CAST(length({_DOCUMENT_TEXT}) AS INT) AS n_chars,
            upper(lang[1:1]) || lower(lang[2:]) AS lang FROM texts""",
        ),
    ),
    "clean_names": (
        _cells({"name": ss.name_cleaner(), "surname": ss.name_cleaner(case_transform="lower")}),
        _people(
            f"SELECT _row_index, {q.name('name')} AS name, lower({q.name('surname')}) AS surname FROM people"
        ),
    ),
    "clean_names_letters_only": (
        _cells({"name": ss.name_cleaner(allow_spaces=False, case_transform="upper")}),
        _people("SELECT _row_index, upper(regexp_replace(name, '[^a-zA-Z]', '', 'g')) AS name FROM people"),
    ),
    "clean_contacts": (
        _cells({"contact": ss.contact_cleaner(normalize_10_digits=True)}),
        _people(f"SELECT _row_index, {q.ten_digits('contact')} AS contact FROM people"),
    ),
    "contact_styles": (
        contact_styles,
        _people(
            f"""SELECT _row_index,
            CASE WHEN length(ten) = 10 THEN ten[1:5] || '-' || ten[6:] ELSE ten END AS hyphenated,
            CASE WHEN length(d) = 10 THEN '+91 ' || d[1:5] || ' ' || d[6:]
                 WHEN length(d) > 10 AND starts_with(d, '91') THEN '+91 ' || d[3:7] || ' ' || d[8:]
                 ELSE d END AS international, d AS raw_digits
            FROM (SELECT _row_index, {q.ten_digits('contact')} AS ten, {q.digits('contact')} AS d FROM people)"""
        ),
    ),
    "clean_emails": (
        _cells({"email": ss.email_cleaner()}),
        _people(f"SELECT _row_index, {q.email('email')} AS email FROM people"),
    ),
    "email_rejects": (lambda s, sf: _reasons(s, sf, "email", ss.email_cleaner()), _people(_REJECTED_EMAIL)),
    "first_email_rejects": (
        lambda s, sf: ss.first_rejects(people(s, sf), "email", ss.email_cleaner()),
        _people(_REJECTED_EMAIL + " ORDER BY row_index LIMIT 50"),
    ),
    "contact_rejects": (
        lambda s, sf: _reasons(s, sf, "contact", ss.contact_cleaner(normalize_10_digits=True, strict=True)),
        _people(
            f"""SELECT _row_index AS row_index, contact AS original, {q.ten_digits('contact')} AS cleaned,
            CASE WHEN {_LEN} = 0 THEN 'empty' ELSE 'Unusual digit length (' || CAST({_LEN} AS STRING) || ')' END AS reason
            FROM people WHERE {_LEN} < 7 OR {_LEN} > 15"""
        ),
    ),
    "date_rejects": (
        lambda s, sf: _reasons(s, sf, "placed", ss.date_cleaner(), order_dates),
        q.with_(
            ORDER_DATES_SQL,
            f"""SELECT _row_index AS row_index, placed AS original, placed AS cleaned,
            'Could not parse date with specified rules' AS reason
            FROM order_dates WHERE placed IS NOT NULL AND {q.date('placed')} IS NULL""",
        ),
    ),
    "clean_dates": (_order_dates({}), _order_dates_sql("%Y-%m-%d")),
    "clean_dates_dmy_out": (_order_dates({"output_format": "DD/MM/YYYY"}), _order_dates_sql("%d/%m/%Y")),
    "clean_dates_custom_out": (
        _order_dates({"output_format": "%d %b %Y at %H:%M", "input_format": "DD/MM/YYYY"}),
        _order_dates_sql("%d %b %Y at %H:%M"),
    ),
    "clean_dates_typed": (
        as_real_dates,
        q.with_(
            ORDER_DATES_SQL, f"SELECT _row_index, CAST({q.date('placed')} AS DATE) AS placed FROM order_dates"
        ),
    ),
    "empty_to_null": (
        empty_to_null,
        _people(
            "SELECT _row_index, "
            + ", ".join(f"CASE WHEN {q.is_empty(c)} THEN NULL ELSE {c} END AS {c}" for c in ("city", "email", "salary"))
            + " FROM people"
        ),
    ),
    "empty_to_null_no_placeholders": (
        empty_to_null_no_placeholders,
        _people(
            "SELECT _row_index, "
            + ", ".join(
                f"CASE WHEN lower({q.strip(c)}) IN ('', 'building  town') THEN NULL ELSE {c} END AS {c}"
                for c in ("city", "salary")
            )
            + " FROM people"
        ),
    ),
    "empty_to_null_exact": (
        empty_to_null_exact,
        _people(
            f"""SELECT _row_index, CASE WHEN lower(city) IN {q.in_list(('', *q.PLACEHOLDERS))} THEN NULL
            ELSE city END AS city FROM people"""
        ),
    ),
    "to_integer": (
        converted("salary", "integer"),
        _people(f"SELECT _row_index, CAST(round_even({q.number('salary')}, 0) AS BIGINT) AS salary FROM people"),
    ),
    "to_float": (converted("salary", "Float"), _people(f"SELECT _row_index, {q.number('salary')} AS salary FROM people")),
    "to_float_filled": (
        converted("salary", "Float", fill_unconvertible=-1.0),
        _people(f"SELECT _row_index, COALESCE({q.number('salary')}, -1.0) AS salary FROM people"),
    ),
    "to_boolean": (converted("is_active", "Boolean"), _people(f"SELECT _row_index, {_TRUTH} AS is_active FROM people")),
    "to_date": (
        converted("joined", "Date"),
        _people(f"SELECT _row_index, strftime({q.date('joined')}, '%Y-%m-%d') AS joined FROM people"),
    ),
    "to_datetime": (
        converted("joined", "Datetime"),
        _people(f"SELECT _row_index, CAST({q.date('joined')} AS TIMESTAMP) AS joined FROM people"),
    ),
    "to_string_title": (
        converted("name", "String", case_transform="title", collapse_spaces=True),
        _people(f"SELECT _row_index, {q.title(q.squeeze('name'))} AS name FROM people"),
    ),
    "convert_rejects": (convert_rejects, _CONVERT_REJECTS),
    "string_preview": (
        lambda s, sf: ss.preview_strings(people(s, sf), "city", case_transform="title", collapse_spaces=True),
        _people(
            f"""SELECT row_index, original_value, transformed_value, original_value <> transformed_value AS changed
            FROM (SELECT _row_index AS row_index, city AS original_value, {q.title(q.squeeze('city'))} AS transformed_value
                  FROM people WHERE city IS NOT NULL ORDER BY _row_index LIMIT 10)"""
        ),
    ),
    "change_counts": (change_counts, _CHANGE_COUNTS),
    "quick_fix": (quick_fix, _QUICK_FIX),
}

