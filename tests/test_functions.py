"""Edge cases of the column functions."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adplan.functions import labels, text
from adplan.functions.dates import _votes, date_readings, day_first, with_date, with_range_start
from adplan.functions.numeric import ratio, rnd, text_to_number, total

day = datetime.date


def values(spark, rows, kind, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text_to_number(spark):
    shown = ["$1,234.50", "12.5%", " 7 ", "-3", "1e3", ".5", "12abc", "5d", "(1,200)", "NaN", "Infinity", "$", None, "1.2.3"]
    assert values(spark, shown, "string", text_to_number) == [
        1234.5, 12.5, 7.0, -3.0, 1000.0, 0.5, None, None, None, None, None, None, None, None]


def test_blank_tokens(spark):
    assert values(spark, ["", "N/A", "n/a", "--", "—", "NA", "0"], "string", text.blank_to_null) == [
        None, None, None, None, None, "NA", "0"]


def test_campaign_type(spark):
    shown = [" SP ", "Headline Search Ads", "sponsored tv-ads", "SPONSORED DISPLAY (SD)", "o'neil 2nd run", None]
    assert values(spark, shown, "string", text.campaign_type) == [
        "Sponsored Products", "Sponsored Brands", "Sponsored Tv-Ads", "Sponsored Display", "O'Neil 2Nd Run", None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abzAZ019 -_.'/", min_size=1, max_size=12), min_size=1, max_size=20))
def test_title_case_is_the_usual_one(spark, words):
    assert values(spark, [w.lower() for w in words], "string", text.title_case) == [w.lower().title() for w in words]


DATES = {
    "2025-03-01": day(2025, 3, 1), "2025/3/1": day(2025, 3, 1), "20250301": day(2025, 3, 1),
    "03/01/2025": day(2025, 3, 1), "3-1-2025": day(2025, 3, 1), "Mar 1, 2025": day(2025, 3, 1),
    "March 1 2025": day(2025, 3, 1), "Sept. 5, 2024": day(2024, 9, 5), "1 Mar 2025": day(2025, 3, 1),
    "2025-03-01 10:20:30": day(2025, 3, 1), "2025-03-01T10:20:30": day(2025, 3, 1), "2025-03": day(2025, 3, 1),
    "Mar 2025": day(2025, 3, 1), "2025-02-30": None, "13/13/2025": None, "n/a": None, "": None, "12": None,
    "Foo 1, 2025": None, None: None,
}
RANGES = {
    "2025-01-01 - 2025-01-31": day(2025, 1, 1), "Jan 1, 2025 - Jan 31, 2025": day(2025, 1, 1),
    "January 1 2025 – January 31 2025": day(2025, 1, 1), "Jan 1, 2025 - Dec 31, 2025": None,
    "2025-01-01-2025-01-07": day(2025, 1, 1), "W1: 2025-01-01 - 2025-01-07": day(2025, 1, 1),
    "2025-01-01 - 2025-13-31": None, "2025-03-01": day(2025, 3, 1), "Mar 1, 2025": day(2025, 3, 1), "x": None,
}


DAY_FIRST = {
    "31/01/2025": day(2025, 1, 31), "15/02/2025": day(2025, 2, 15), "01/02/2025": day(2025, 2, 1), "1-3-2025": day(2025, 3, 1),
    "Mar 4, 2025": day(2025, 3, 4), "2025-04-05": day(2025, 4, 5), "06/05/2025 10:00": day(2025, 5, 6), "12/31/2025": None,
    "02/2025": day(2025, 2, 1), "1/2/2025 3/4/2025": None, "a/b/2025": None, "32/01/2025": None, "29/02/2024": day(2024, 2, 29),
    "29/02/2025": None, "0/1/2025": None, "1/0/2025": None, "20251301": None, "2025-1-1T5:00Z": day(2025, 1, 1), "1 Jan 2025 3 PM": None}
DAY_FIRST_RANGES = {
    "01/02/2025 - 28/02/2025": day(2025, 2, 1), "03/02/2025 – 09/02/2025": day(2025, 2, 3), "week of 05/06/2025 - 07/06/2025": day(2025, 6, 5),
    "01/01/2025 - 31/12/2025": None, "1 May 2025 - 8 May 2025": day(2025, 5, 1), "2025-05-01 00:00 - 2025-05-02 23:59:59": day(2025, 5, 1),
    "1/2/2025": day(2025, 2, 1)}


@pytest.mark.parametrize("cases,read", [(DAY_FIRST, with_date), (DAY_FIRST_RANGES, with_range_start), (DATES, with_date), (RANGES, with_range_start)])
def test_dates(spark, cases, read):
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    found = {r.t: r.d for r in read(df, F.col("t"), "d").collect()}
    assert found == cases


def test_the_order_of_day_and_month_holds_for_the_column(spark):
    df = spark.createDataFrame([("31/01/2025", "01/31/2025", "1/2/2025", None), ("15/02/2025", "2/1/2025", "3/4/2025", None),
                                ("01/02/2025", "13/1/2025", None, None), ("x", "12/25/2025", "", None)], "a string, b string, c string, d string")
    assert date_readings(df, {"a": False, "b": False, "c": False, "d": True}) == {
        "a": (4, 3, True), "b": (4, 3, False), "c": (3, 2, False), "d": (0, 0, False)}
    assert date_readings(df, {"a": False})["a"].undated == 1
    told = lambda first: [r.d for r in with_date(df, F.col("c"), "d", first).collect()]
    assert told(True)[:2] == [day(2025, 2, 1), day(2025, 4, 3)] and told(False)[:2] == [day(2025, 1, 2), day(2025, 3, 4)]


def test_rounding_is_half_even_on_doubles(spark):
    shown = [0.125, 0.375, 2.5, -0.125, 1.005]
    assert values(spark, shown, "double", lambda c: rnd(c, 2)) == [0.12, 0.38, 2.5, -0.12, 1.0]
    assert values(spark, [0.5, 1.5, 2.5], "double", lambda c: rnd(c, 0)) == [0.0, 2.0, 2.0]


def test_ratio_of_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 4.0), (None, 2.0), (50000.0, 200000.0)], "a double, b double")
    assert [r.q for r in df.select(ratio(F.col("a"), F.col("b"), 2, 100.0).alias("q")).collect()] == [None, 0.0, None, 25.0]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-10**14, 10**14), min_size=1, max_size=30))
def test_sums_are_exact_in_any_order(spark, units):
    rows = [(u / 10_000,) for u in units]
    df = spark.createDataFrame(rows, "x double")
    got = df.agg(total(df, "x").alias("s")).first().s
    assert got == spark.createDataFrame(rows[::-1], "x double").agg(total(df, "x").alias("s")).first().s
    assert abs(got - sum(units) / 10_000) <= 1e-9 * max(1.0, abs(sum(units) / 10_000))


def test_sums_leave_out_what_is_no_amount(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert df.agg(total(df, "x").alias("s")).first().s == 1.5
    none = spark.createDataFrame([(None,)], "x double")
    assert none.agg(total(none, "x").alias("s")).first().s == 0.0


def test_sums_hold_more_than_a_long_of_units(spark):
    df = spark.range(2000).select(F.lit(8.0e14).alias("x"))
    assert df.agg(total(df, "x").alias("s")).first().s == 1.6e18


def test_delta(spark):
    df = spark.createDataFrame([(110.0, 100.0), (100.0, 100.0), (90.0, 100.0), (5.0, 0.0), (5.0, None), (None, 4.0)],
                               "n double, o double")
    got = [tuple(r.d) for r in df.select(labels.delta(F.col("n"), F.col("o")).alias("d")).collect()]
    assert got == [(10.0, "up", True), (None, "flat", None), (-10.0, "down", False), (None, "flat", None),
                   (None, "flat", None), (-100.0, "down", False)]


def test_bands(spark):
    assert values(spark, [0.0, 20.0, 20.1, 35.0, 35.1, None], "double", labels.acos_band) == [
        None, "Efficient", "Acceptable", "Acceptable", "High", None]
    assert values(spark, [80.0, 79.9, 55.0, 35.0, 34.9], "double", labels.tier) == [
        "Scale", "Optimise", "Optimise", "Review", "Pause"]


def test_sums_keep_what_lies_below_a_ten_thousandth(spark):
    from adplan.functions.numeric import total

    df = spark.range(1_000_000).selectExpr("0.00004D AS x", "-0.75D AS y", "1e12D AS z")
    row = df.agg(total(df, "x").alias("x"), total(df, "y").alias("y"), total(df, "z").alias("z")).first()
    assert (row.x, row.y, row.z) == (40.0, -750_000.0, 1e18)


def test_order_of_day_and_month_is_matched_once_per_text(spark):
    # Three rows of one text outvote two rows of two texts; the patterns stand above the counts of texts.
    rows = ["13/1/2025"] * 3 + ["1/13/2025", "1/14/2025", None, "x"]
    df = spark.createDataFrame([(x, f"1/2/2025 - {x}") for x in rows], "a string, b string")
    votes = _votes(df, {"a": False, "b": True})
    assert {r.column: r.vote for r in votes.collect()} == {"a": 1, "b": 1}
    plan = votes._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in plan.split("Aggregate [column")[1] and "regexp_extract" not in plan.split("Aggregate [column")[2]
    assert day_first(df.filter("a = 'none'"), {"a": False}) == {"a": False}


def test_signs_are_stripped_without_taking_cells_apart(spark):
    df = spark.createDataFrame([("$1,234.50",), (" 12.5% ",), ("$,%",), ("1,2é",), ("--",), (None,)], "c string").select(text_to_number(F.col("c")).alias("n"))
    assert [r.n for r in df.collect()] == [1234.5, 12.5, None, None, None, None]
    assert "translate" not in df._jdf.queryExecution().optimizedPlan().toString()
