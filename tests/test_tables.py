import math
from decimal import Decimal
from itertools import zip_longest

import pytest
from pyspark.sql import functions as F

import sparkscrub as ss
from sparkscrub.operators import order_stats
from sparkscrub.operators.dedupe import first_duplicate_rows
from sparkscrub.operators.ordered_fill import ordered_fill
from sparkscrub.operators.running import dense_index, running_total
from sparkscrub.operators.type_profile import first_values


def cells(df, name="v"):
    return [r[name] for r in df.orderBy("_row_index").collect()]


def test_fill_mean_and_median(table):
    df = table("v double", [(10.0,), (None,), (30.0,), (float("nan"),), (35.0,), (45.0,)])
    assert cells(ss.fill_nulls(df, "v", "mean"))[1] == 30.0
    assert cells(ss.fill_nulls(df, "v", "median"))[3] == 32.5


def test_fill_mean_of_text_and_of_nothing(table):
    df = table("v string", [("10",), ("x",), ("",), ("20.5",)])
    assert cells(ss.fill_nulls(df, "v", "mean")) == ["10", "x", "15.25", "20.5"]
    words = table("v string", [("x",), (None,)])
    assert cells(ss.fill_nulls(words, "v", "median", fill_value="none")) == ["x", "none"]


def test_mode_takes_the_smallest_of_several(table):
    df = table("v string", [("b",), ("a",), ("b",), ("a",), (None,), ("c",)])
    assert cells(ss.fill_nulls(df, "v", "mode"))[4] == "a"


def test_fill_constant_widens_only_when_needed(table):
    df = table("v bigint", [(1,), (None,)])
    assert cells(ss.fill_nulls(df, "v", fill_value=5)) == [1, 5]
    assert cells(ss.fill_nulls(df, "v", fill_value=0.5)) == [1.0, 0.5]
    assert cells(ss.fill_nulls(df, "v")) == ["1", "Unknown"]


def test_blanks_count_as_null_unless_told_otherwise(table):
    df = table("v string", [("a",), ("",), ("  ",), (None,)])
    assert cells(ss.fill_nulls(df, "v")) == ["a", "Unknown", "Unknown", "Unknown"]
    assert cells(ss.fill_nulls(df, "v", treat_empty_as_null=False)) == ["a", "", "  ", "Unknown"]
    dropped = ss.fill_nulls(df, "v", "remove_rows")
    assert cells(dropped) == ["a"]
    assert tuple(ss.null_report(df, dropped, "v").first()) == (3, 3)


def test_neighbour_fills(table):
    values = [None, 1, None, None, 4, None, 6, None]
    df = table("v int", [(v,) for v in values])
    assert cells(ss.forward_fill(df, ["v"])) == [None, 1, 1, 1, 4, 4, 6, 6]
    assert cells(ss.backward_fill(df, ["v"])) == [1, 1, 4, 4, 4, 6, 6, None]


@pytest.mark.parametrize("partitions", [1, 4, 16])
@pytest.mark.parametrize("backward", [False, True])
def test_fill_does_not_depend_on_partitions_or_buckets(spark, partitions, backward):
    rows = [(i * 7, float(i) if i % 37 == 5 else None, f"t{i}" if i % 53 == 1 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "_row_index bigint, v double, t string").repartition(partitions)
    got = ordered_fill(df, ["v", "t"], backward, bucket_bits=4, block_bits=3).orderBy("_row_index").collect()
    want, last = [], [None, None]
    for _, v, t in reversed(rows) if backward else rows:
        last = [v if v is not None else last[0], t if t is not None else last[1]]
        want.append(tuple(last))
    assert [(r["v"], r["t"]) for r in got] == (want[::-1] if backward else want)


def test_running_total_per_key(spark):
    rows = [(i, "ab"[i % 2], i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "_row_index bigint, k string, n bigint").repartition(7)
    got = running_total(df, F.col("n"), "before", keys=["k"], bucket_bits=3, block_bits=2)
    sums, want = {"a": 0, "b": 0}, {}
    for i, k, n in rows:
        want[i] = sums[k]
        sums[k] += n
    assert {r["_row_index"]: r["before"] for r in got.collect()} == want


def test_dense_index(spark):
    df = spark.createDataFrame([(2**40 + 3, "c"), (5, "a"), (900, "b")], "_row_index bigint, v string")
    assert [tuple(r) for r in dense_index(df).orderBy("_row_index").collect()] == [(0, "a"), (1, "b"), (2, "c")]


@pytest.mark.parametrize("n", [1, 2, 999, 1000])
def test_long_median_is_exact(spark, n):
    """The narrowing path, forced by a small limit, with a value that fills a third of the rows."""
    values = [float((i * 7919) % 1009) if i % 3 else 500.0 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    want = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    assert order_stats.column_medians(df, ["v"], small=10) == {"v": want}


def jobs_of(spark, run):
    """What ``run`` returns, and how many jobs it took."""
    group = f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_medians_of_many_columns_take_as_many_jobs_as_of_few(spark):
    wide = spark.range(3000).selectExpr(*[f"CASE WHEN id % {i + 2} = 1 THEN NULL ELSE pmod(xxhash64(id, {i}), 1000 * {i} + 7) END AS c{i}" for i in range(40)])
    rows = wide.collect()
    taken = {}
    for n in (3, 40):
        names = wide.columns[:n]
        found, taken[n] = jobs_of(spark, lambda: order_stats.column_medians(wide, names, small=100))
        for c in names:
            ordered = sorted(r[c] for r in rows if r[c] is not None)
            assert found[c] == (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
        exact, _ = jobs_of(spark, lambda: order_stats.exact_medians(wide, names, small=100))
        assert {c: float(v) for c, v in exact.items()} == found
    assert taken[40] <= 2 * taken[3] < 40  # by round, not by column


def test_medians_of_values_that_are_hard_to_tell_apart(spark):
    """Ends of the range of DOUBLE, both signs, zeros, near neighbours, and long DECIMALs, down to the last bit."""
    inf, big = float("inf"), Decimal("79228162514264337593543950336")
    doubles = [-inf, -1.7e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.7e308, inf]
    decimals = [-big, -big + 1, Decimal(-1), Decimal(0), Decimal("0.01"), Decimal("0.02"), big, big + 1]
    for k in range(3):
        d, e = [v for v in doubles[k:] for _ in range(3)], [v for v in decimals[k:] for _ in range(3)]
        df = spark.createDataFrame([(x, y) for x, y in zip_longest(d + [float("nan")], e)], "d double, e decimal(38,2)")
        middle = lambda v: (sorted(v)[(len(v) - 1) // 2], sorted(v)[len(v) // 2])
        for small in (0, 2, 10**6):
            assert order_stats.column_medians(df, ["d"], small=small) == {"d": sum(middle(d)) / 2}
            assert order_stats.exact_medians(df, ["e"], small=small) == {"e": sum(middle(e)) / 2}


def test_medians_scan_as_often_for_more_rows(spark):
    """Rounds are bounded by the width of a number, not by how many values there are."""
    taken = []
    for n in (2_000, 200_000):
        df = spark.range(n).selectExpr("cast(xxhash64(id) as double) / 1e9 as v", "-cast(id as double) as w")
        got, jobs = jobs_of(spark, lambda: order_stats.column_medians(df, ["v", "w"], small=50))
        assert got["w"] == -(n - 1) / 2
        taken.append(jobs)
    assert taken[1] <= taken[0] + 6


def test_first_values_of_many_sparse_columns(spark):
    wide = spark.range(5000).selectExpr("id AS _row_index", *[f"CASE WHEN id % {97 + i} = {i} THEN id * {i} END AS c{i}" for i in range(30)])
    rows = wide.collect()
    taken = {}
    for n in (3, 30):
        names = wide.columns[1:n + 1]
        got, taken[n] = jobs_of(spark, lambda: [tuple(r) for r in first_values(wide, names, n=20, near=16).collect()])
        want = [(i, r["_row_index"], str(r[c])) for i, c in enumerate(names) for r in [x for x in rows if x[c] is not None][:20]]
        assert sorted(got) == sorted(want)
    assert taken[30] == taken[3]


def test_nth_value_everywhere(spark):
    values = [float(v) for v in [5] * 40 + list(range(100)) + [7.5] * 40]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 5, 30, 47, 90, 120, 179):
        assert order_stats.nth_value(df, len(values), k, small=3) == sorted(values)[k]


def test_dedupe(table):
    df = table("id bigint, v string", [(1, "A"), (1, "A"), (2, "B"), (None, None), (None, None)])
    assert cells(ss.remove_duplicates(df), "_row_index") == [0, 2, 3]
    assert cells(ss.remove_duplicates(df, keep="last"), "_row_index") == [1, 2, 4]
    assert cells(ss.remove_duplicates(df, ["v", "nope"], keep="odd"), "_row_index") == [0, 2, 3]


def test_nan_and_null_are_one_group(table):
    df = table("v double", [(float("nan"),), (None,), (1.0,), (float("nan"),)])
    assert cells(ss.remove_duplicates(df), "_row_index") == [0, 2]
    assert ss.duplicate_summary(df).first()["duplicate_rows"] == 2
    assert cells(ss.duplicate_rows(df), "_row_index") == [0, 1, 3]


def test_dedupe_of_nested_columns(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (0L, map('a', 1), array(1)), (1L, map('a', 1), array(1)), (2L, map('b', 1), array(1)) "
        "AS t(_row_index, m, a)"
    )
    assert cells(ss.remove_duplicates(df), "_row_index") == [0, 2]
    assert cells(ss.duplicate_rows(df), "_row_index") == [0, 1]


def test_empty_table(table, spark):
    df = table("v string", [])
    assert tuple(ss.duplicate_summary(df).first()) == (0, 0, 0.0, False)
    profile = ss.profile_dataset(df)
    assert (profile.quality.first()["score"], profile.quality.first()["grade"]) == (100, "N/A")


def test_duplicate_members_survive_many_groups(spark, monkeypatch):
    from sparkscrub.operators import dedupe

    monkeypatch.setattr(dedupe, "HOT_GROUPS", 2)
    df = spark.range(300).select(
        F.col("id").alias("_row_index"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 90).alias("v")
    )
    rows = [(i, 0 if i % 3 == 0 else i % 90) for i in range(300)]
    sizes = {}
    for _, v in rows:
        sizes[v] = sizes.get(v, 0) + 1
    want = [i for i, v in rows if sizes[v] > 1]
    assert cells(ss.duplicate_rows(df), "_row_index") == want
    assert cells(first_duplicate_rows(df, n=9), "_row_index") == want[:9]


def test_profile_of_nulls(table):
    df = table("city string", [("Mumbai",), ("",), ("   ",), ("Delhi",), (None,)])
    for options in ({}, {"one_scan": True}, {"approx_distinct": True}):
        row = ss.analyze_nulls(df, **options).first()
        assert (row["null_count"], row["na_count"], row["empty_string_count"]) == (3, 1, 2)
        assert (row["null_percentage"], row["unique_values"], row["duplicate_values"]) == (60.0, 4, 0)


def test_profile_of_all_kinds(spark):
    df = spark.sql("SELECT 1 AS i, double('nan') AS d, map('a', 1) AS m, array(1) AS a, date'2020-01-01' AS t, true AS b")
    for one_scan in (False, True):
        rows = {r["column"]: r for r in ss.analyze_nulls(df, one_scan=one_scan).collect()}
        assert {c: (r["na_count"], r["unique_values"]) for c, r in rows.items()} == {
            "i": (0, 1), "d": (1, 0), "m": (0, 1), "a": (0, 1), "t": (0, 1), "b": (0, 1),
        }


def detected(df, **options):
    rows = ss.detect_column_types(df, **options).orderBy("position").collect()
    return {r["column"]: (r["detected_type"], r["action"]) for r in rows}


def test_semantic_types(table):
    schema = "Last_Name string, mail string, hotel string, when_joined string, born string, price string, note string, n bigint"
    rows = [
        ("Miller", "a@b.com", "Grand", "2020-01-02", "1/2/2000", "₹1,000", "tidy", 1),
        ("/Brown", "x@y.org", "Palace", "soon", "3-4-2001", "2.5", " untidy", 2),
        ("...Stone", "A@b.com", "Inn", "later", "5.6.2002", "x", "tidy", None),
        (None, None, None, None, "??", "7", None, None),
    ]
    want = {
        "Last_Name": ("Name", "Clean Names"),
        "mail": ("Email", "Clean Email"),
        "hotel": ("Phone", "Clean Contact"),
        "when_joined": ("Date", "Fix Date"),
        "born": ("Date", "Fix Date"),
        "price": ("String", "Convert to Float"),
        "note": ("String", "Trim Spaces"),
        "n": ("Integer", None),
    }
    df = table(schema, rows)
    assert detected(df) == want
    assert detected(df, mode="full") == want
    assert detected(df, word_match=True)["hotel"] == ("String", None)


def test_sample_looks_at_the_first_hundred(spark):
    df = spark.range(300).select(
        F.col("id").alias("_row_index"),
        F.when(F.col("id") < 50, None).when(F.col("id") < 150, "a@b.c").otherwise("word").alias("v"),
    ).repartition(5)
    assert detected(df, mode="sample")["v"][0] == "Email"
    assert detected(df)["v"][0] == "String"  # all values, unless asked otherwise


def test_quality_grades(table):
    clean_rows = table("a bigint, b double", [(i, i / 2) for i in range(10)])
    row = ss.profile_dataset(clean_rows).quality.first()
    assert tuple(row) == (100, "Excellent", 100.0, 100.0, 100.0, 0, 0)
    bad = table("a bigint, b string", [(1, " x")] * 10)
    row = ss.profile_dataset(bad).quality.first()
    assert (row["uniqueness_score"], row["type_integrity_score"], row["score"]) == (0.0, 75.0, 62)


def test_search_is_literal_unless_asked(table):
    df = table("v string, n double", [("a.c", 1.0), ("abc", None), (None, float("nan"))])
    assert cells(ss.search_rows(df, "A.C"), "_row_index") == [0]
    assert cells(ss.search_rows(df, "a.c", regex=True), "_row_index") == [0, 1]
    assert cells(ss.search_rows(df, "(("), "_row_index") == []


def test_sort_puts_missing_last_both_ways(table):
    df = table("v double", [(2.0,), (None,), (float("nan"),), (1.0,)])
    assert [r["_row_index"] for r in ss.sort_rows(df, "v").collect()] == [3, 0, 1, 2]
    assert [r["_row_index"] for r in ss.sort_rows(df, "v", ascending=False).collect()] == [0, 3, 1, 2]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_cover_the_table(spark, direction):
    df = spark.range(47).select(F.col("id").alias("_row_index"), (F.col("id") % 6).alias("k")).repartition(3)
    want = sorted(range(47), key=lambda i: (i % 6 if direction == "asc" else -(i % 6), i))
    got = []
    for p in range(1, 6):
        page = ss.preview(df, page=p, page_size=10, sort_col="k", sort_dir=direction)
        got += [r["_row_index"] for r in page.rows.collect()]
    assert got == want
    assert (page.total_pages, ss.preview(df, page=99, page_size=10).current_page) == (5, 5)
    none = ss.preview(df, search_query="zzz")
    assert (none.total_pages, none.current_page, none.rows.count()) == (1, 1, 0)


@pytest.mark.parametrize("sort_col", [None, "k", "d"])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_deep_pages(spark, monkeypatch, direction, sort_col):
    """Pages far from both ends are found by their first key, through ties and missing keys."""
    from sparkscrub.operators import order_stats, preview

    monkeypatch.setattr(preview, "DEEP", 5)
    monkeypatch.setattr(order_stats, "SMALL", 8)
    def key(i):
        return None if i % 7 == 0 else i % 3

    rows = [(i, key(i), None if key(i) is None else f"2020-01-0{key(i) + 1}") for i in range(200)]
    df = spark.createDataFrame(rows, "_row_index bigint, k int, d string").withColumn("d", F.col("d").cast("date"))
    sign = 1 if direction == "asc" else -1
    want = sorted(range(200), key=lambda i: (key(i) is None, sign * (key(i) or 0), i) if sort_col else i)
    got = []
    for p in range(1, 6):
        page = ss.preview(df.repartition(3), page=p, page_size=40, sort_col=sort_col, sort_dir=direction).rows
        got += [r["_row_index"] for r in page.collect()]
    assert got == want


def test_first_values_beyond_the_first_rows(spark):
    from sparkscrub.operators.type_profile import first_values

    df = spark.range(1000).select(
        (F.col("id") * 3).alias("_row_index"), F.lit("x").alias("a"),
        F.when(F.col("id") % 50 == 49, F.col("id").cast("string")).alias("b"), F.lit(None).cast("string").alias("c"),
    ).repartition(4)
    got = first_values(df, ["a", "b", "c"], n=10, near=60).orderBy("position", "row_index").collect()
    assert [r["row_index"] for r in got if r["position"] == 0] == [i * 3 for i in range(10)]
    assert [r["value"] for r in got if r["position"] == 1] == [str(49 + 50 * i) for i in range(10)]
    assert [r for r in got if r["position"] == 2] == []


def test_page_shows_plain_cells(spark):
    df = spark.sql("SELECT 0L AS _row_index, timestamp_ntz'2020-01-02 03:04:05' AS t, double('nan') AS d, date'2020-01-02' AS u")
    row = ss.preview(df).rows.first()
    assert (row["t"], row["d"], row["u"]) == ("2020-01-02T03:04:05", None, "2020-01-02")


def test_unions_and_selection(table):
    a, b = table("x bigint, y string", [(1, "a")]), table("x bigint, z string", [(2, "b")])
    assert ss.schemas_match([a, a]) and not ss.schemas_match([a, b]) and ss.schemas_match([a])
    tables = {"Page 1 - Table 1 (x)": a, "Page 2 - Table 1 (x)": b}
    assert ss.select_table(tables)[0] == "Page 1 - Table 1 (x)"
    assert ss.select_table(tables, "page 2")[1].columns == ["_row_index", "x", "z"]
    assert ss.select_table(tables, "nothing like it")[0] == "Page 1 - Table 1 (x)"
    name, both = ss.select_table(tables, "combined")
    assert [tuple(r)[1:] for r in both.orderBy("_row_index").collect()] == [(1, "a", None), (2, None, "b")]
    assert ss.select_table({"p": a, "q": a})[0] == "All Tables (Combined)"


def test_json_safe(spark):
    from sparkscrub.sinks.writers import json_safe

    df = spark.sql("SELECT double('inf') AS d, array(double('nan'), 1.0D) AS a, struct(double('-inf') AS x, 2 AS y) AS s")
    row = json_safe(df).first()
    assert (row["d"], row["a"], row["s"]["x"], row["s"]["y"]) == (None, [None, 1.0], None, 2)
    assert not any(isinstance(x, float) and math.isnan(x) for x in row["a"])


def test_exact_fills(spark):
    df = spark.sql("""SELECT * FROM VALUES (0, CAST(2 AS DECIMAL(10, 0)), 9007199254740993, CAST(1 AS TINYINT)),
        (1, CAST(3 AS DECIMAL(10, 0)), 9007199254740995, NULL), (2, NULL, NULL, NULL) AS t(_row_index, d, b, t)""")
    d = ss.fill_nulls(df, column="d", strategy="mean").orderBy("_row_index").collect()
    assert [str(r.d) for r in d] == ["2.00", "3.00", "2.50"]
    b = ss.fill_nulls(df, column="b", strategy="median").orderBy("_row_index").collect()
    assert [int(r.b) for r in b] == [9007199254740993, 9007199254740995, 9007199254740994]
    t = ss.fill_nulls(df, column="t", fill_value=300).orderBy("_row_index").collect()
    assert [r.t for r in t] == [1, 300, 300]


def test_union_index_does_not_collide(spark):
    a = spark.createDataFrame([((256 << 40) + 5, "a"), (5, "b")], "_row_index bigint, v string")
    b = spark.createDataFrame([(5, "c"), (1 << 60, "d")], "_row_index bigint, v string")
    got = ss.union_tables([a, b, a.limit(0)]).orderBy("_row_index").collect()
    assert [(r[0], r.v) for r in got] == [(0, "b"), (1, "a"), (2, "c"), (3, "d")]


def test_rank_search_over_texts(spark):
    from sparkscrub.operators.order_stats import nth_text

    texts = sorted(["same prefix of many " + str(i % 13) for i in range(60)] + ["", "a", "a\0", "zebra", "é"], key=lambda t: t.encode())
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for k in (0, 1, 2, 3, 30, 62, 63, 64):
        assert nth_text(df, len(texts), k, small=2) == texts[k]


def test_junk_is_no_date(spark):
    from sparkscrub.functions.dates import parse_free_date

    words = ["Junk 5 2024", "Market 12 2024", "Mayor 1 2024", "12 decoys 2023", "Decimal 10 20", "Monkey 5 May 2024", "5 Sept 2024", "Sunday, 5 may 2024", "June 7 1999"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [str(r.d)[:10] for r in df.select("i", parse_free_date(F.col("w")).alias("d")).orderBy("i").collect()]
    assert got == ["None"] * 6 + ["2024-09-05", "2024-05-05", "1999-06-07"]
