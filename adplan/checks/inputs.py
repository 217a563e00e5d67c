"""Inputs that several queries share, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adplan import fixtures
from adplan.operators import breakdowns as bd
from adplan.operators import health as hl
from adplan.operators import kpis as kp
from adplan.operators import timeseries as ts
from adplan.plans import budget, scenarios
from adplan.plans.settings import Scenario, growth_scenarios
from adplan.sources.stage import settle

CUSTOM = [
    Scenario("pin_revenue", target_revenue=3.0e9),
    Scenario("pin_spend", ad_spend=2.0e8),
    Scenario("pin_sales", ad_sales=9.0e8),
    Scenario("pin_roas", growth_pct=5, roas=6.0),
    Scenario("pin_tacos", growth_pct=5, tacos=8.0),
    Scenario("pin_spend_and_roas", ad_spend=1.0e8, roas=6.0, tacos=8.0),
]
ADS_HEADERS = {
    "Date": "report_date", "Advertised product ID": "asin", "Campaign name ": "campaign_name",
    "Ad product": "campaign_type", "Targeting match type": "match_type", "Search term": "search_term",
    "Campaign bid strategy": "bid_strategy",
    "Impressions": "impressions", "Clicks": "clicks", "Total cost": "spend", "14 day total sales ($)": "ad_sales",
    "Purchases": "ad_orders", "Purchases (new to brand)": "ad_orders_ntb",
}
VENDOR_HEADERS = {
    "Date": "report_date", "ASIN": "asin", "Product title": "product_title",
    "OPS ($)": "ordered_revenue", "Shipped COGS ($)": "shipped_revenue", "Units ordered": "ordered_units",
    "Units shipped": "shipped_units", "Glance views": "glance_views",
}


def as_text(name: str) -> Column:
    """A measure the way reports print it."""
    c = F.col(name)
    shown = F.format_number(c, 4)
    if name in ("spend", "ad_sales", "ordered_revenue"):
        return F.when(c == 0, "--").otherwise(F.concat(F.lit("$"), shown))
    if name == "ad_orders":
        return F.when(c == 0, "N/A").otherwise(shown)
    return F.concat(F.lit(" "), shown, F.lit(" "))


def raw_text(df: DataFrame, headers: dict[str, str], *more: Column) -> DataFrame:
    """The table under report headers, all cells text."""
    kinds = dict(df.dtypes)
    return df.select(*[
        (as_text(c) if kinds[c] == "double" else F.col(c).cast("string")).alias(h)
        for h, c in headers.items()
    ], *more)


def raw_ads_report(spark: SparkSession, folder: str) -> DataFrame:
    return raw_text(fixtures.raw_ads(spark, folder), ADS_HEADERS)


def raw_vendor_report(spark: SparkSession, folder: str) -> DataFrame:
    return raw_text(fixtures.vendor(spark, folder), VENDOR_HEADERS)


def ads(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.ads(spark, folder)


def vendor(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.vendor(spark, folder)


def kpis(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    return kp.ads_kpis(ads(spark, folder), by)


def vendor_kpis(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    return kp.vendor_kpis(vendor(spark, folder), by)


def campaigns(spark: SparkSession, folder: str) -> DataFrame:
    return bd.campaign_breakdown(ads(spark, folder), ordered=False)


def products(spark: SparkSession, folder: str, one_sided: bool = False) -> DataFrame:
    return bd.product_breakdown(fixtures.ads(spark, folder, one_sided), ordered=False)


def vendor_products(spark: SparkSession, folder: str, one_sided: bool = False) -> DataFrame:
    return bd.asin_vendor_breakdown(fixtures.vendor(spark, folder, one_sided=one_sided), ordered=False)


def health(spark: SparkSession, folder: str) -> DataFrame:
    return hl.asin_health(settle(products(spark, folder), "products"), vendor_products(spark, folder), ordered=False)


def base(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    return scenarios.baselines(kpis(spark, folder, by), vendor_kpis(spark, folder, by), by)


def plan(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    return scenarios.forecast(base(spark, folder, by), growth_scenarios(), by)


def monthly(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    return ts.trend(ads(spark, folder), "M", by, ordered=False)


def actuals(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    return ts.monthly_actuals(monthly(spark, folder, by), by)


def optimised(spark: SparkSession, folder: str) -> DataFrame:
    return budget.optimise_budget(campaigns(spark, folder), "spend", ordered=False)
