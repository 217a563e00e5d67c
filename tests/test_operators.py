"""Operators on small hand-made tables: worked examples, edges and invariants."""

import pytest
from pyspark.sql import functions as F

from adplan.checks import inputs as inp
from adplan.functions.schema import ADS_ALIASES
from adplan.operators import attach, blended, breakdowns, health, ingest, kpis, timeseries, topk
from adplan.operators import timeseries as ts
from adplan.operators.summary import summarise
from adplan.plans import budget, monthly, rules, scenarios
from adplan.plans.account import account_tables, facts_of, rule_tables
from adplan.plans.settings import Scenario, growth_scenarios, normalise_weights
from adplan.sources import reports, stage

SMALL = "/root/testdata/sf0.001"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def base(spark, revenue, spend, sales):
    return spark.createDataFrame([(revenue, spend, sales)], "revenue double, spend double, ad_sales double")


def test_worked_ratios(spark):
    df = spark.createDataFrame([(50000.0, 200000.0, 25000.0, 5000000.0, 500.0)],
                               "spend double, ad_sales double, clicks double, impressions double, ad_orders double")
    k = one(kpis.ads_kpis(df))
    assert (k.overall_acos, k.overall_roas, k.overall_cpc, k.overall_ctr, k.conversion_rate) == (25.0, 4.0, 2.0, 0.5, 2.0)
    assert k.ntb_order_pct is None and k.total_ad_orders_ntb == 0.0


def test_worked_scenario(spark):
    plan = one(scenarios.forecast(base(spark, 1000000.0, 100000.0, 400000.0), growth_scenarios([10])))
    assert (plan.target_revenue, plan.target_ad_sales, plan.projected_acos_pct) == (1100000.0, 440000.0, 26.0)
    assert (plan.recommended_spend, plan.projected_roas, plan.projected_tacos_pct) == (114400.0, 3.85, 10.4)
    split = scenarios.channel_allocation(scenarios.forecast(base(spark, 1000000.0, 100000.0, 400000.0), growth_scenarios([10])))
    assert {r.channel: r.budget for r in split.collect()} == {
        "Sponsored Products": 74360.0, "Sponsored Brands": 28600.0, "Sponsored Display": 11440.0}


@pytest.mark.parametrize("scenario,field,value", [
    (Scenario("s", target_revenue=1200000.0), "growth_pct", 20.0),
    (Scenario("s", ad_sales=500000.0, roas=6.0), "recommended_spend", 83333.33),
    (Scenario("s", target_revenue=1200000.0, tacos=8.0), "recommended_spend", 96000.0),
    (Scenario("s", ad_spend=80000.0, roas=6.0, tacos=8.0), "recommended_spend", 80000.0),
])
def test_pinned_metrics(spark, scenario, field, value):
    row = one(scenarios.forecast(base(spark, 1000000.0, 100000.0, 400000.0), [scenario]))
    assert row[field] == value and row.is_custom


def test_scenario_without_sales(spark):
    row = one(scenarios.forecast(base(spark, 1000.0, 0.0, 0.0), growth_scenarios([10])))
    assert row.current_acos_pct is None and row.target_ad_sales == 40.0
    assert row.recommended_spend == pytest.approx(8.32)
    empty = one(scenarios.forecast(base(spark, 0.0, 0.0, 0.0), growth_scenarios([10])))
    assert empty.projected_acos_pct == 0.0 and empty.projected_roas is None


def test_weights():
    assert normalise_weights({"a": 1, "b": 3}) == {"a": 0.25, "b": 0.75}
    assert normalise_weights({"Sponsored Products": 0})["Sponsored Products"] == 0.65


def test_null_keys_and_missing_measures(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", None)], "match_type string, spend double")
    assert [tuple(r) for r in breakdowns.breakdown(df, "match_type", ["spend", "clicks"]).collect()] == [("a", 1.0)]
    assert breakdowns.breakdown(df, "match_type", ["spend"], keep_null=True).count() == 2
    assert breakdowns.breakdown(df, "match_type", ["clicks"]).columns == ["match_type"]


def test_health_edges(spark):
    rows = [("a", 15.0, 6.0, 15.0, 60.0, 100.0), ("b", None, None, None, None, 0.0), ("c", 14.99, 5.99, 4.99, 20.0, 50.0)]
    df = spark.createDataFrame(rows, "asin string, acos_pct double, roas double, cvr_pct double, ntb_pct double, impressions double")
    got = {r.asin: (r.score, r.tier) for r in health.asin_health(df).collect()}
    assert got == {"a": (18 + 30 + 20 + 15 + 10, "Scale"), "b": (2.0, "Pause"), "c": (25 + 22 + 0 + 5 + 6, "Optimise")}


def test_quantiles_are_exact(spark):
    n = 60_001
    df = spark.range(n).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % n % 5000 * 1.5).alias("v"))
    got = {r.g: (r.q1, r.q3) for r in health.exact_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}, ["g"]).collect()}
    want = {r.g: tuple(r.q) for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).collect()}
    assert got == want
    whole = one(health.exact_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}))
    assert (whole.q1, whole.q3) == tuple(one(df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))).q)


@pytest.mark.parametrize("rows, groups, value", [
    (2_000_000, 2, "CASE WHEN id % 7 = 0 THEN 1e15 * rand(3) WHEN id % 5 = 0 THEN 3.0 ELSE 1000 * rand(4) - 100 END"),
    (400_000, 100_000, "floor(50 * rand(4))")])
def test_quantiles_of_large_and_of_many_groups(spark, rows, groups, value):
    df = stage.settle(spark.range(rows).selectExpr(f"nullif(id % {groups}, 1) AS g", f"{value} AS v"))
    got = health.exact_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}, ["g"])
    want = df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    both = got.join(want.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")))
    off = both.filter((F.abs(F.col("q1") - F.col("q")[0]) > 1e-9 * F.abs("q1")) | (F.abs(F.col("q3") - F.col("q")[1]) > 1e-9 * F.abs("q3")))
    assert (both.count(), off.count()) == (groups, 0)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "g int, v double")
    assert health.exact_quantiles(none, "v", {"q1": 0.25}, ["g"]).count() == 0
    assert one(health.exact_quantiles(none, "v", {"q1": 0.25})).q1 is None


def test_quantiles_with_one_value_holding_most_rows(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 20_000, 7.0).otherwise(F.col("id") * 1.0).alias("v"))
    got = one(health.exact_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}))
    assert (got.q1, got.q3) == tuple(one(df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))).q)


def test_attach_hot_entity(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"),
                                  F.col("id").cast("double").alias("x"))
    out = attach.attach_totals(df, {"s": F.sum("x"), "n": F.count(F.lit(1))}, ["k"])
    assert out.count() == 1000 and out.filter("k = 'hot'").select("n").distinct().first().n == 900
    null = spark.createDataFrame([(None, 1.0), (None, 2.0)], "k string, x double")
    assert [r.s for r in attach.attach_totals(null, {"s": F.sum("x")}, ["k"]).collect()] == [3.0, 3.0]


def test_full_outer_merge(spark):
    ads = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "asin string, spend double, brand string")
    ven = spark.createDataFrame([("b", 10.0, "z"), ("c", 0.0, "w")], "asin string, ordered_revenue double, brand string")
    got = {r.asin: (r.tacos_pct, r.brand_ads, r.brand_vendor) for r in blended.merge_asin_view(ads, ven).collect()}
    assert got == {"a": (None, "x", None), "b": (20.0, "y", "z"), "c": (None, None, "w")}
    assert blended.merge_asin_view(ads, None) is ads and blended.merge_asin_view(None, ven) is ven


def test_budget_invariants(spark):
    df = spark.createDataFrame([(f"c{i}", float(i * 10), float(i * i), float(i)) for i in range(50)],
                               "campaign_name string, spend double, ad_sales double, roas double")
    out = budget.optimise_budget(df, 1000.0)
    assert abs(sum(r.optimised_budget for r in out.collect()) - 1000) <= 50 * 0.005
    idle = df.select("campaign_name", F.lit(0.0).alias("spend"), F.lit(0.0).alias("ad_sales"), F.lit(0.0).alias("roas"))
    assert {r.optimised_budget for r in budget.optimise_budget(idle, 1000.0).collect()} == {20.0}


def test_top_n_with_other_adds_up(spark):
    df = spark.createDataFrame([("e", f"c{i:02d}", float(i)) for i in range(1, 31)], "e string, k string, v double")
    for by in ((), ("e",)):
        rows = topk.top_n_with_other(df, "v", "v", "k", 12, by).collect()
        assert len(rows) == 13 and sum(r.v for r in rows) == 465.0


def test_trend_summary_needs_two_periods(spark):
    df = spark.createDataFrame([("a", "2025-01-05", 1.0), ("b", "2025-01-05", 1.0), ("b", "2025-02-05", 0.0), ("b", "2025-03-01", 3.0)],
                               "brand string, report_date string, spend double")
    series = timeseries.trend(df, "M", ["brand"])
    got = timeseries.trend_summary(series, ["brand"]).collect()
    assert [(r.brand, r.spend_change_pct) for r in got] == [("b", None)]


def test_date_column_choice(spark):
    df = spark.createDataFrame([("x", None, "2025-01-05"), ("y", "1/2/2025", None)],
                               "start_date string, week_date string, date_range string")
    assert timeseries.date_choice(df).column == "week_date"
    assert timeseries.resolve_date(df).count() == 1


def test_monthly_plan_without_actuals(spark):
    plan = scenarios.forecast(base(spark, 1000000.0, 100000.0, 400000.0), growth_scenarios([10]))
    rows = monthly.monthly_plan(plan, None).collect()
    assert len(rows) == 12 and abs(sum(r.projected_spend for r in rows) - 114400.0) < 0.1
    assert monthly.plan_totals(monthly.monthly_plan(plan, None)).filter("month is null").count() == 1


def test_all_clear(spark):
    df = spark.createDataFrame([(10.0, 100.0, 10.0, 1000.0, 1.0)],
                               "spend double, ad_sales double, clicks double, impressions double, ad_orders double")
    facts = rules.account_facts(kpis.ads_kpis(df))
    assert [r.metric for r in rules.anomalies(facts).collect()] == ["All Clear"]
    places = [r.place for r in rules.actions(facts).orderBy("place").collect()]
    assert places == list(range(1, len(places) + 1))


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "ads.csv"
    path.write_bytes("﻿Campaign name,Total cost, Sales ,14 day total sales ($),Custom\n"
                     '"A, b","$1,234.50",--,$10.00,5%\nC,n/a,2.5,,7%\n'.encode())
    out = reports.read_report(spark, str(path), "ads")
    assert out.columns == ["campaign_name", "spend", "ad_sales", "custom"]
    assert [tuple(r) for r in out.orderBy("campaign_name").collect()] == [
        ("A, b", 1234.5, 10.0, 5.0), ("C", None, 2.5, 7.0)]
    headers = reports.report_headers(spark, [str(path)])
    assert ingest.classify_reports(headers).first().kind == "ads"


def test_encoding_and_stacking(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_bytes("Campaign name,Spend\nCafé,1\n".encode("latin-1"))
    b.write_bytes("Campaign name,Clicks\nX,2\n".encode("latin-1"))
    out = reports.read_reports(spark, [str(a), str(b)], encoding="ISO-8859-1")
    assert sorted((r.campaign_name, r.spend, r.clicks) for r in out.collect()) == [("Café", 1.0, None), ("X", None, 2.0)]


def test_stage_prunes_months(spark, tmp_path):
    df = spark.createDataFrame([("2025-01-05", 1.0), ("2025-02-05", 2.0)], "d string, x double").withColumn("d", F.to_date("d"))
    stage.save_stage(df, str(tmp_path / "s"), "d")
    kept = stage.load_stage(spark, str(tmp_path / "s")).filter("month = DATE '2025-02-01'")
    assert [r.x for r in kept.collect()] == [2.0]
    assert "PartitionFilters: [isnotnull(month" in kept._jdf.queryExecution().toString()


def test_missing_columns(spark):
    df = spark.createDataFrame([("a",)], "asin string")
    assert ingest.missing_columns(df, "ads") == ["spend", "ad_sales"]
    assert ingest.missing_columns(df, "vendor") == ["ordered_revenue"]


def test_header_case_and_collisions(spark):
    df = spark.createDataFrame([(None, "2", "x"), ("1", "3", "y")], "`Cost` string, `SPEND ` string, `A.b` string")
    out = ingest.normalise_columns(df, ADS_ALIASES)
    assert out.columns == ["spend", "a.b"] and [r.spend for r in out.collect()] == ["2", "1"]


def test_files_are_read_under_their_own_headers(spark, tmp_path):
    from adplan.sources.reports import read_report, report_headers

    (tmp_path / "a one.csv").write_text("Campaign name,Spend,Sales\nx,1.5,10\n")
    (tmp_path / "b.csv").write_text("Spend,Campaign name,Sales\n3,y,20\n")
    (tmp_path / "c.csv").write_text("Campaign name,Spend,Sales,Oddity\nz,4,30,\"$1,000\"\n")
    (tmp_path / "d.csv").write_text("Campaign name,Spend,Sales,Oddity\nw,5,40,none such\n")
    rows = {r.campaign_name: r for r in read_report(spark, str(tmp_path / "*.csv")).collect()}
    assert {k: (r.spend, r.ad_sales, r.oddity) for k, r in rows.items()} == {
        "x": (1.5, 10.0, None), "y": (3.0, 20.0, None), "z": (4.0, 30.0, 1000.0), "w": (5.0, 40.0, None)}
    heads = report_headers(spark, str(tmp_path / "*.csv")).collect()
    assert sorted(len(r.headers) for r in heads) == [3, 3, 4, 4]


def test_breakdowns_without_a_campaign_and_by_a_dimension(spark):
    from adplan.operators.breakdowns import all_breakdowns
    from adplan.operators.summary import slice_of, summarise

    df = spark.createDataFrame([("SP", "a", 1.0, 2.0), ("SB", "a", 3.0, 4.0), ("SP", "b", 5.0, 6.0)],
                               "campaign_type string, asin string, spend double, ad_sales double")
    got = {(r.dimension, r.key): r.spend for r in all_breakdowns(df).collect()}
    assert got == {("campaign", "SP"): 6.0, ("campaign", "SB"): 3.0, ("ad_product", "SP"): 6.0, ("ad_product", "SB"): 3.0,
                   ("asin", "a"): 4.0, ("asin", "b"): 5.0}
    own = summarise(df, {"campaign": "campaign_type", "asin": "asin"}, ["asin"])
    assert {r.asin: r.spend for r in slice_of(own, "asin", "asin").collect()} == {"a": 4.0, "b": 5.0}
    assert slice_of(own, "account").count() == 2 and slice_of(own, "campaign", "campaign_type").count() == 3


def test_each_file_is_read_in_its_own_encoding(spark, tmp_path):
    from adplan.sources.reports import files_by_header, read_report, route_reports

    for name, text in (("a.csv", "Campaign name,Total cost,Sales\nCafé,1,2\n".encode()), ("b.csv", "Campaign name,Total cost,Sales\nGröße,3,4\n".encode("utf-8-sig")),
                       ("c.csv", "Campaign name,Total cost,Sales\nñandú,5,6\n".encode("latin-1")), ("d.csv", b"")):
        (tmp_path / name).write_bytes(text)
    (tmp_path / "v.csv").write_text("ASIN,OPS ($),Glance views\nB1,10,2\n")
    folder = str(tmp_path)
    assert [(g.encoding, len(g.files)) for g in files_by_header(spark, f"{folder}/[a-d].csv")] == [("ISO-8859-1", 1), ("UTF-8", 2)]
    rows = {r.campaign_name: (r.spend, r.ad_sales) for r in read_report(spark, f"{folder}/[a-d].csv").collect()}
    assert rows == {"Café": (1.0, 2.0), "Größe": (3.0, 4.0), "ñandú": (5.0, 6.0)}
    found = route_reports(spark, ads=f"{folder}/*.csv")
    assert found.ads.count() == 3 and found.vendor.first().ordered_revenue == 10.0
    assert {(r.file[-5], r.kind, r.moved) for r in found.files.collect()} == {("a", "ads", False), ("b", "ads", False), ("c", "ads", False), ("v", "vendor", True)}
    alone = route_reports(spark, vendor=f"{folder}/a.csv")
    assert alone.vendor is None and alone.ads.count() == 1 and alone.files.first().moved


def test_facts_of_rules_come_from_what_rules_look_at(spark):
    ads, vendor = inp.ads(spark, SMALL), inp.vendor(spark, SMALL)
    wide, slim = account_tables(ads, vendor, by=["brand"]), rule_tables(ads, vendor, by=["brand"])
    assert set(slim["campaigns"].columns) < set(wide["campaigns"].columns)
    one, other = (facts_of(t, "+10%", ["brand"]).orderBy("brand").collect() for t in (wide, slim))
    assert one == other and len(one) > 0


def test_a_dimension_moves_only_the_sums_it_is_wanted_with(spark):
    ads = inp.ads(spark, SMALL)
    dims = {"campaign": "campaign_name", "asin": "asin"}
    some, whole = summarise(ads, dims, only={"campaign": ["spend"], "asin": ["clicks", "idle_spend"]}), summarise(ads, dims)
    both = some.alias("s").join(whole.alias("w"), [F.col("s.dimension") == F.col("w.dimension"), F.col("s.key").eqNullSafe(F.col("w.key"))])
    rows = both.select("s.dimension", *[F.array(f"s.{c}", f"w.{c}").alias(c) for c in ("spend", "clicks", "idle_spend", "ad_sales")]).collect()
    wanted = {"account": ["spend", "clicks", "idle_spend", "ad_sales"], "campaign": ["spend"], "asin": ["clicks", "idle_spend"]}
    assert {r.dimension for r in rows} == set(wanted)
    for r in rows:
        for c in ("spend", "clicks", "idle_spend", "ad_sales"):
            assert r[c][0] == (r[c][1] if c in wanted[r.dimension] else None)


def test_account_tables_sum_months_like_trend(spark):
    ads = inp.ads(spark, SMALL)
    got = account_tables(ads, months=True)["months"]
    want = ts.trend(ads, "M")
    assert got.columns == want.columns and got.orderBy("period_start").collect() == want.collect()
    assert "months" not in account_tables(ads.drop("report_date"), months=True)
