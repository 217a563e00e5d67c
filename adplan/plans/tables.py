"""The seven tables of a media plan, and their writer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adplan.functions.numeric import have
from adplan.operators.attach import attach
from adplan.plans.scenarios import channel_allocation
from adplan.plans.settings import DEFAULT_SPLIT
from adplan.sources.versions import manifest, publish, read_version

# Labels of the summary, with their KPI column and divisor.
SUMMARY = [
    ("Total Ordered Revenue (Vendor)", "total_ordered_revenue", 1.0),
    ("Total Ad Spend", "total_spend", 1.0),
    ("Total Ad-Attributed Sales", "total_ad_sales", 1.0),
    ("Overall ACOS (%)", "overall_acos", 100.0),
    ("Overall ROAS", "overall_roas", 1.0),
    ("Total Impressions", "total_impressions", 1.0),
    ("Total Clicks", "total_clicks", 1.0),
    ("Overall CTR (%)", "overall_ctr", 100.0),
    ("CPC ($)", "overall_cpc", 1.0),
    ("Avg Selling Price ($)", "avg_selling_price", 1.0),
]

# Display names of the health and monthly tables.
HEALTH_NAMES = {
    "asin": "ASIN", "score": "Health Score (0–100)", "tier": "Tier",
    "spend": "Ad Spend ($)", "ad_sales": "Ad Sales ($)", "roas": "ROAS",
    "acos_pct": "ACOS (%)", "cvr_pct": "CVR (%)", "ntb_pct": "NTB (%)",
    "impressions": "Impressions", "ordered_revenue": "Ordered Revenue ($)",
    "ordered_units": "Ordered Units",
}
MONTHLY_NAMES = {
    "month": "Month", "month_name": "Month Name", "actual_spend": "Actual Spend ($)",
    "actual_ad_sales": "Actual Ad Sales ($)", "actual_acos_pct": "Actual ACOS (%)",
    "actual_roas": "Actual ROAS", "actual_impressions": "Actual Impressions",
    "projected_spend": "Projected Spend ($)", "projected_ad_sales": "Projected Ad Sales ($)",
    "projected_acos_pct": "Projected ACOS (%)", "projected_roas": "Projected ROAS",
    "events": "Key Events", "is_event_month": "Event Month?", "uplift_pct": "Spend Uplift %",
    "sp_budget": "SP Budget ($)", "sb_budget": "SB Budget ($)", "sd_budget": "SD Budget ($)",
}


def plan_executive_summary(kpis: DataFrame, vendor: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Ten labelled baseline figures; ACOS and CTR as fractions, 0 when unknown."""
    if vendor is None:
        both = kpis.withColumns({c: F.lit(None).cast("double") for c in ("total_ordered_revenue", "avg_selling_price")})
    else:
        both = attach(kpis, vendor.select(*by, "total_ordered_revenue", "avg_selling_price"), by)
    rows = []
    for i, (label, name, divisor) in enumerate(SUMMARY, start=1):
        value = F.col(name) if divisor == 1.0 else F.coalesce(F.col(name), F.lit(0.0)) / divisor
        rows.append(F.struct(F.lit(i).alias("line"), F.lit(label).alias("label"), value.alias("value")))
    return both.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def plan_scenarios(plan: DataFrame, split: Mapping[str, float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per scenario with budget and extra budget of each channel as columns."""
    split = split or DEFAULT_SPLIT
    keys = [*by, "scenario_id"]
    wide = (channel_allocation(plan, split, by).groupBy(*keys).pivot("channel", list(split))
            .agg(F.first("budget").alias("budget"), F.first("incremental_budget").alias("incremental")))
    named = {f"{c}_{k}": f"{c.lower().replace(' ', '_')}_{k}" for c in split for k in ("budget", "incremental")}
    base = plan.select(
        *keys, "growth_pct", "baseline_revenue", "target_revenue", "revenue_gap", "current_ad_spend",
        "recommended_spend", "incremental_spend", "target_ad_sales", "projected_acos_pct", "projected_roas",
        "projected_tacos_pct")
    return base.join(wide.withColumnsRenamed(named), keys)


def plan_campaign_recs(recommendations: DataFrame, scenario_id: str) -> DataFrame:
    """Campaign recommendations of one scenario."""
    return recommendations.filter(F.col("scenario_id") == scenario_id)


def _renamed(df: DataFrame, names: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    return df.select(*by, *[F.col(c).alias(names[c]) for c in have(df, names)])


def plan_health(health: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Health table under display names."""
    return _renamed(health, HEALTH_NAMES, by)


def plan_monthly(months: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Monthly plan under display names; month number and month name stay two columns."""
    return _renamed(months, MONTHLY_NAMES, [*by, *have(months, ["scenario_id"])])


def media_plan_tables(kpis: DataFrame, vendor: DataFrame | None, plan: DataFrame, scenario_id: str,
                      recommendations: DataFrame, campaigns: DataFrame, products: DataFrame,
                      health: DataFrame | None = None, months: DataFrame | None = None,
                      split: Mapping[str, float] | None = None, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables by name, all lazy."""
    out = {
        "executive_summary": plan_executive_summary(kpis, vendor, by),
        "scenarios": plan_scenarios(plan, split, by),
        "campaign_recommendations": plan_campaign_recs(recommendations, scenario_id),
        "campaign_performance": campaigns,
        "asin_analysis": products,
    }
    if health is not None:
        out["asin_health"] = plan_health(health, by)
    if months is not None:
        out["monthly_plan"] = plan_monthly(months, by)
    return out


def write_media_plan(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet",
                     mode: str = "error") -> dict[str, str]:
    """Write the tables as one plan; returns their paths.

    Readers (`read_media_plan`) see all tables of a plan or, while it is written or when a table fails, all of the one
    before. Without ``mode`` overwrite a folder that holds a plan is an error.
    """
    spark = next(iter(tables.values())).sparkSession
    if mode not in ("overwrite", "error"):
        raise ValueError("mode is overwrite or error")
    if mode == "error" and manifest(spark, folder) is not None:
        raise ValueError(f"{folder} holds a plan")
    return {n: t["path"] for n, t in publish(spark, folder, tables, fmt=fmt)["tables"].items()}


def read_media_plan(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the plan that was written last and whole."""
    return read_version(spark, folder)
