"""All tables of an account, or of many entities, from one pass over each report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adplan.functions.dates import period_start
from adplan.functions.numeric import have, rnd
from adplan.functions.schema import CAMPAIGN_DIMENSIONS, CORE_MEASURES, FULL_MEASURES
from adplan.operators.breakdowns import asin_vendor_breakdown, breakdown
from adplan.operators.health import asin_health
from adplan.operators.kpis import ads_kpis, vendor_kpis
from adplan.operators.ratios import add_ctr, add_ntb_pct, add_ratios
from adplan.operators.summary import ACCOUNT, IDLE, slice_of, summarise
from adplan.operators.timeseries import date_choice, resolve_date
from adplan.plans import rules
from adplan.plans.scenarios import baselines, forecast
from adplan.plans.settings import Scenario, growth_scenarios
from adplan.sources.stage import settle


# What the rules and the scores look at, by dimension.
RULE_MEASURES = {"campaign": ("spend", "ad_sales"), "asin": (*CORE_MEASURES, "ad_orders_ntb")}


def account_tables(ads: DataFrame, vendor: DataFrame | None = None, scenarios: Sequence[Scenario] | None = None,
                   by: Sequence[str] = (), months: bool = False) -> dict[str, DataFrame]:
    """KPIs, breakdowns, health and scenarios by name.

    The advertising report is read once: its groupings are summed together and settled,
    and everything else works on those sums. The vendor report is read once per result. What needs a column
    that the report lacks is an empty table, or left out (waste). With ``months`` the same pass also sums
    the months (as ``trend``), if the report has dates.
    """
    present = have(ads, CAMPAIGN_DIMENSIONS)
    dims = ({"campaign": present[0]} if present else {}) | ({"asin": "asin"} if "asin" in ads.columns else {})
    only = {}
    if months and date_choice(ads) is not None:
        # Rows without a date count in all other groupings.
        ads = resolve_date(ads, out="__date", keep_undated=True).withColumn("__month", period_start(F.col("__date"), "M"))
        dims, only = dims | {"months": "__month"}, {"months": CORE_MEASURES}
    sums = settle(summarise(ads, dims, by, only=only), "sums", "dimension")
    account = slice_of(sums, ACCOUNT)

    def slice_or_none(dimension: str, column: str) -> DataFrame:
        return slice_of(sums, dimension, column) if dimension in dims else breakdown(ads, column, FULL_MEASURES, by)

    out = {
        "kpis": ads_kpis(account, by, wide=True),
        "campaigns": add_ratios(slice_or_none("campaign", dims.get("campaign", CAMPAIGN_DIMENSIONS[0]))),
        "products": add_ntb_pct(add_ratios(slice_or_none("asin", "asin"))),
    }
    if "months" in dims:
        series = slice_of(sums, "months", "period_start").withColumn("period_start", F.to_date("period_start"))
        out["months"] = add_ctr(add_ratios(series.select(*by, "period_start", *have(series, CORE_MEASURES)))).drop("cvr_pct")
    if IDLE in sums.columns:
        out["waste"] = account.select(*by, rnd(F.col(IDLE), 2).alias("wasted_spend"))
    if vendor is not None:
        out["vendor_kpis"] = settle(vendor_kpis(vendor, by), "vendor")
        out["vendor_products"] = settle(asin_vendor_breakdown(vendor, by, ordered=False), "vendor")
    out["health"] = asin_health(out["products"], out.get("vendor_products"), by, ordered=False)
    base = baselines(out["kpis"], out.get("vendor_kpis"), by)
    out["plan"] = forecast(base, scenarios or growth_scenarios(), by)
    return out


def rule_tables(ads: DataFrame, vendor: DataFrame | None = None, scenarios: Sequence[Scenario] | None = None,
                by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Like :func:`account_tables`, with no more than the rules and score plans look at.

    Campaigns carry spend and sales, products what their score is made of, and neither moves other sums;
    products have no vendor figures, so these are not summed either.
    """
    present = have(ads, CAMPAIGN_DIMENSIONS)
    dims = ({"campaign": present[0]} if present else {}) | ({"asin": "asin"} if "asin" in ads.columns else {})
    sums = settle(summarise(ads, dims, by, only=RULE_MEASURES), "sums", "dimension")
    account = slice_of(sums, ACCOUNT)

    def ratios_of(dimension: str, column: str) -> DataFrame:
        df = slice_of(sums, dimension, column) if dimension in dims else breakdown(ads, column, FULL_MEASURES, by)
        return add_ratios(df.select(*by, column, *have(df, RULE_MEASURES[dimension])))

    out = {"kpis": ads_kpis(account, by, wide=True), "campaigns": ratios_of("campaign", dims.get("campaign", CAMPAIGN_DIMENSIONS[0])),
           "health": asin_health(add_ntb_pct(ratios_of("asin", "asin")), by=by, ordered=False)}
    if IDLE in sums.columns:
        out["waste"] = account.select(*by, rnd(F.col(IDLE), 2).alias("wasted_spend"))
    if vendor is not None:
        out["vendor_kpis"] = settle(vendor_kpis(vendor, by), "vendor")
    out["plan"] = forecast(baselines(out["kpis"], out.get("vendor_kpis"), by), scenarios or growth_scenarios(), by)
    return out


def facts_of(tables: Mapping[str, DataFrame], scenario_id: str | None, by: Sequence[str] = (),
             campaign: str | None = None) -> DataFrame:
    """The facts that the rules look at, from the tables of an account."""
    campaign = campaign or have(tables["campaigns"], CAMPAIGN_DIMENSIONS)[0]
    return rules.account_facts(
        tables["kpis"], tables.get("vendor_kpis"), tables["campaigns"], tables["health"], tables["plan"],
        scenario_id, tables.get("waste"), by, campaign)
