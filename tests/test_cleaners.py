import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import sparkscrub as ss


def test_strings(column):
    got = column(["  Mumbai  ", "   Pune   ", "delhi", "new \t delhi", "   ", None], ss.string_cleaner(case_transform="title"))
    assert got == ["Mumbai", "Pune", "Delhi", "New Delhi", None, None]


def test_string_options(column):
    plain = dict(trim_whitespace=False, remove_extra_spaces=False, empty_to_null=False)
    assert column([" a  b ", "  "], ss.string_cleaner(**plain)) == [" a  b ", "  "]
    assert column(["a#b-c_d.e!"], ss.string_cleaner(remove_special_chars=True)) == ["ab-c_d.e"]
    assert column(["x12y"], ss.string_cleaner(custom_regex_replace=(r"(\d+)", "<$1>"))) == ["x<12>y"]
    assert column(["hELLO wORLD"], ss.string_cleaner(case_transform="capitalize")) == ["Hello world"]


def test_string_counts_null_status(report):
    assert report(["a", " a", "  ", None], ss.string_cleaner())[0] == 2


def test_all_strings_leave_numbers(table):
    df = table("a string, b string, n bigint", [(" apple", "cat ", 1), ("banana", " dog", 2)])
    rows = ss.clean_all_strings(df, case_transform="upper").orderBy("_row_index").collect()
    assert [tuple(r)[1:] for r in rows] == [("APPLE", "CAT", 1), ("BANANA", "DOG", 2)]


def test_empty_to_null(column, report):
    cells = ["Ann", "", "   ", "Bob", "N/A", None, " unknown "]
    assert column(cells, ss.empty_to_null_cleaner()) == ["Ann", None, None, "Bob", None, None, None]
    assert report(cells, ss.empty_to_null_cleaner())[0] == 4
    exact = ss.empty_to_null_cleaner(include_whitespace=False)
    assert column(cells, exact) == ["Ann", None, "   ", "Bob", None, None, " unknown "]
    custom = ss.empty_to_null_cleaner(include_placeholders=False, custom_placeholders=[" BOB "])
    assert column(cells, custom) == ["Ann", None, None, None, "N/A", None, " unknown "]


def test_names(column, report):
    cells = ["Miller", "/Brown", "...Stone", "Reed_", "anna_lena", "42grey", None, "De  la-Cruz", "Zoë"]
    want = ["Miller", "Brown", "Stone", "Reed", "Anna Lena", "Grey", None, "De La Cruz", "Zo"]
    assert column(cells, ss.name_cleaner()) == want
    assert report(cells, ss.name_cleaner())[0] == 7
    assert column(["ab cd", "??"], ss.name_cleaner(allow_spaces=False, case_transform="upper")) == ["ABCD", ""]
    assert column([" o'neil  x1 "], ss.name_cleaner(alphabets_only=False)) == ["O'Neil X1"]


def test_contacts(column, report):
    cells = ["+91-98765-43210", "98abc7654321", "98765 43210"]
    assert column(cells, ss.contact_cleaner()) == ["919876543210", "987654321", "9876543210"]
    assert report(cells, ss.contact_cleaner()) == (3, [])


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({"normalize_10_digits": True}, ["9876543210", "9876543210", "", "12345", "44123456789012"]),
        ({"normalize_10_digits": True, "format_style": "hyphenated"}, ["98765-43210", "98765-43210", "", "12345", "44123456789012"]),
        ({"format_style": "international"}, ["+91 98765 43210", "09876543210", "", "12345", "44123456789012"]),
        ({"normalize_10_digits": True, "country_code": "44"}, ["919876543210", "9876543210", "", "12345", "44123456789012"]),
    ],
)
def test_contact_options(column, options, want):
    cells = ["+91 98765 43210", "098765 43210", "none", "12345", "44123456789012"]
    assert column(cells, ss.contact_cleaner(**options)) == want


def test_contact_rejects(report):
    cells = ["12345", "none", "1" * 16, "1234567", None]
    want = [(0, "12345", "Unusual digit length (5)"), (2, "1" * 16, "Unusual digit length (16)")]
    assert report(cells, ss.contact_cleaner()) == (1, want)
    assert report(cells, ss.contact_cleaner(strict=True))[1][1] == (1, "", "empty")


def test_whole_number_phones_gain_no_zero(column):
    assert column([9876543210, None], ss.contact_cleaner(), "c bigint") == ["9876543210", None]


def test_emails(column, report):
    cells = [" ann.lee@gmai.com ", "BOB@YAHOOO.COM", "no-mail", "x@nodot", "a b@c.d", "N/A", "p@q@gmial.com", None]
    want = ["ann.lee@gmail.com", "bob@yahoo.com", "no-mail", "x@nodot", "ab@c.d", "N/A", "p@q@gmial.com", None]
    assert column(cells, ss.email_cleaner()) == want
    changed, rejects = report(cells, ss.email_cleaner())
    assert changed == 3
    assert [(i, why.split()[0]) for i, _, why in rejects] == [(2, "Missing"), (3, "Missing"), (6, "Invalid")]


def test_email_options(column):
    off = ss.email_cleaner(lowercase=False, remove_inner_spaces=False, fix_domain_typos=False)
    assert column([" A b@GMAI.com "], off) == ["A b@GMAI.com"]


def test_dates(column, report):
    cells = ["12/05/2026", "2026-05-12", "12-05-2026", "May 12 2026", " NaT ", "", "soon", None]
    want = ["2026-05-12"] * 4 + [None, None, "soon", None]
    assert column(cells, ss.date_cleaner()) == want
    changed, rejects = report(cells, ss.date_cleaner())
    assert changed == 3
    assert [(i, v) for i, v, _ in rejects] == [(6, "soon")]


def test_date_options(column):
    assert column(["12/05/2026"], ss.date_cleaner(day_first=False, output_format="DD Mon YYYY")) == ["05 Dec 2026"]
    assert column(["05/12/2026", "2026-01-02"], ss.date_cleaner(input_format="MM/DD/YYYY")) == ["2026-05-12", "2026-01-02"]


def test_dates_typed(table):
    df = ss.clean(table("c string", [("12/05/2026",), ("soon",)]), {"c": ss.date_cleaner(as_date=True)})
    assert dict(df.dtypes)["c"] == "date"
    assert [str(r["c"]) for r in df.orderBy("_row_index").collect()] == ["2026-05-12", "None"]


@pytest.mark.parametrize(
    ("target", "cells", "want"),
    [
        ("Float", ["₹50,000", "75000", "unknown", None], [50000.0, 75000.0, None, None]),
        ("integer", ["$1,234.5", "€ 7", "x", "inf"], [1234, 7, None, None]),
        ("Boolean", ["Yes", " f ", "maybe", "0", None], [True, False, None, False, None]),
        ("Date", ["12/05/2026", "x"], ["2026-05-12", None]),
        ("String", [" a ", None], ["a", None]),
        ("Nonsense", [" a "], [" a "]),
    ],
)
def test_convert(column, target, cells, want):
    assert column(cells, ss.type_converter(target)) == want


def test_convert_counts_and_rejects(report):
    changed, rejects = report(["₹50,000", "75000", "unknown", None], ss.type_converter("Float"))
    assert changed == 2
    assert rejects == [(2, "unknown", "Non-numeric characters present")]


def test_fill_unconvertible_fills_old_nulls_too(column):
    assert column(["1", "x", None], ss.type_converter("Float", fill_unconvertible=0)) == [1.0, 0.0, 0.0]


def test_convert_string_case(column):
    cells = ["  mumbai  ", "new   delhi", "BANGALORE", None]
    title = ss.type_converter("String", case_transform="title", collapse_spaces=True)
    assert column(cells, title) == ["Mumbai", "New Delhi", "Bangalore", None]
    assert column(cells, ss.type_converter("String", case_transform="upper"))[1] == "NEW   DELHI"


def test_numbers_are_not_dates(report):
    assert report([20260512], ss.type_converter("Date"), "c bigint")[1][0][2].startswith("Invalid")


def test_preview_strings(table):
    df = table("c string", [(" rahul  sharma ",), (None,), ("Priya Singh",)])
    rows = ss.preview_strings(df, "c", case_transform="title", collapse_spaces=True).collect()
    assert [tuple(r) for r in rows] == [(0, " rahul  sharma ", "Rahul Sharma", True), (2, "Priya Singh", "Priya Singh", False)]


def test_rejects_are_not_capped(spark):
    df = spark.range(120).select(F.col("id").alias("_row_index"), F.lit("bad").alias("c"))
    assert ss.rejects(df, "c", ss.email_cleaner()).count() == 120
    assert ss.first_rejects(df, "c", ss.email_cleaner()).count() == 50


def test_columns_with_odd_names(table):
    df = table("`a.b c` string", [(" x ",)])
    assert ss.clean(df, {"a.b c": ss.string_cleaner()}).first()["a.b c"] == "x"
    with pytest.raises(ValueError, match="no such columns"):
        ss.clean(df, {"nope": ss.string_cleaner()})


CLEANERS = {
    "strings": ss.string_cleaner(),
    "title": ss.string_cleaner(case_transform="title"),
    "names": ss.name_cleaner(),
    "contacts": ss.contact_cleaner(normalize_10_digits=False),
    "emails": ss.email_cleaner(),
    "dates": ss.date_cleaner(),
    "empty": ss.empty_to_null_cleaner(),
}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" aB9@.-/_ é'", max_size=14), min_size=20, max_size=40))
def test_cleaning_twice_changes_nothing_more(spark, cells):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    copies = df.select(*[F.col("c").alias(n) for n in CLEANERS])
    once = ss.clean(copies, CLEANERS)
    moved = ss.count_changes(once, CLEANERS).filter("cells_changed > 0").collect()
    assert moved == []
