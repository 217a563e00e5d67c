"""Every operator on reports that lack a column."""

import pytest

from adplan.operators import breakdowns as bd
from adplan.operators import health, kpis, timeseries
from adplan.plans import rules
from adplan.plans.account import account_tables, facts_of

COLUMNS = {"report_date": "2025-01-05", "campaign_name": "c", "campaign_type": "SP", "targeting": "t", "ad_group_name": "g", "asin": "B1", "match_type": "Exact",
           "bid_strategy": "up", "search_term": "shoe", "category": "x", "brand": "b", "product_title": "p", "impressions": 100.0, "clicks": 9.0, "spend": 5.0,
           "ad_sales": 20.0, "ad_orders": 2.0, "ad_orders_ntb": 1.0, "sales_ntb": 4.0, "ad_sales_longterm": 25.0}
REQUIRED = ("spend", "ad_sales", "report_date", "brand")
OPERATORS = {
    "ads_kpis": kpis.ads_kpis, "campaign": bd.campaign_breakdown, "asin": bd.asin_ads_breakdown, "match_type": bd.match_type_breakdown,
    "bid_strategy": bd.bid_strategy_breakdown, "category": bd.category_breakdown, "ad_product": bd.ad_product_breakdown, "terms": bd.search_term_breakdown,
    "products": bd.product_breakdown, "all": bd.all_breakdowns, "trend": lambda df: timeseries.trend(df, "M"),
    "health": lambda df: health.asin_health(bd.product_breakdown(df)),
}


def report(spark, *absent):
    kept = {c: v for c, v in COLUMNS.items() if c not in absent}
    return spark.createDataFrame([tuple(kept.values())] * 2, ", ".join(f"{c} {'double' if isinstance(v, float) else 'string'}" for c, v in kept.items()))


CAMPAIGN = ("campaign_name", "campaign_type", "targeting", "ad_group_name")


@pytest.mark.parametrize("absent", [(c,) for c in COLUMNS if c not in REQUIRED] + [CAMPAIGN, ("clicks", "impressions", "ad_orders")], ids="-".join)
def test_operators_without_a_column(spark, absent):
    df = report(spark, *absent)
    for name, operator in OPERATORS.items():
        if name == "all" and not set(bd.bulk_dimensions(df)):
            continue
        assert operator(df).columns, name


@pytest.mark.parametrize("absent, by", [(("asin",), ()), (("ad_orders",), ()), (CAMPAIGN, ("brand",)), (("impressions",), ())], ids=["asin", "orders", "campaign", "impressions"])
def test_accounts_without_a_column(spark, absent, by):
    tables = account_tables(report(spark, *absent), None, by=by)
    facts = facts_of(tables, "+10%", by)
    row = facts.first()
    assert row.total_spend == 10.0
    assert (tables["products"].count() == 0) == ("asin" in absent)
    assert (row.wasted_spend is None) == ("ad_orders" in absent)
    assert rules.anomalies(facts, by).count() and rules.actions(facts, by).count()
    assert len(rules.opportunities(facts, by).columns) and rules.narrative_facts(facts, by).count()


def test_without_the_dimension_a_breakdown_is_empty(spark):
    out = bd.search_term_breakdown(report(spark, "search_term"))
    assert out.count() == 0 and out.columns == bd.search_term_breakdown(report(spark)).columns
    assert bd.campaign_breakdown(report(spark, *CAMPAIGN)).columns[0] == "campaign_name"
