"""Month-by-month plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adplan.functions.numeric import have, positive_ratio, rnd
from adplan.operators.attach import attach
from adplan.plans.settings import DEFAULT_SPLIT, calendar_rows

CHANNEL_COLUMNS = {"Sponsored Products": "sp_budget", "Sponsored Brands": "sb_budget",
                   "Sponsored Display": "sd_budget"}


def seasonal_calendar(months: DataFrame, month_col: str = "month") -> DataFrame:
    """Label rows that carry a month number with name, events, flag, multiplier, weight and uplift."""
    calendar = F.element_at(calendar_rows(), F.col(month_col).cast("int"))
    out = months.withColumn("__c", calendar)
    return out.select(
        *months.columns, "__c.month_name", "__c.events", "__c.is_event_month", "__c.multiplier", "__c.weight",
        F.rint((F.col("__c.multiplier") - 1) * 100).alias("uplift_pct"))


def monthly_plan(plan: DataFrame, actuals: DataFrame | None, split: Mapping[str, float] | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Twelve rows per entity and scenario.

    A month with actuals grows by the scenario's percentage. A month without takes its
    seasonal part of the scenario's annual spend and sales. ``actuals`` comes from
    ``monthly_actuals``: at most twelve rows per entity, carried as a map by month.
    """
    split = split or DEFAULT_SPLIT
    scen = plan.select(*by, "scenario_id", "growth_pct", "recommended_spend", "target_ad_sales")
    if actuals is None:
        scen = scen.withColumn("actuals", F.lit(None).cast(
            "map<int,struct<spend:double,ad_sales:double,impressions:double>>"))
    else:
        def value(name: str) -> Column:
            return (F.col(name) if name in actuals.columns else F.lit(None).cast("double")).alias(name)

        entry = F.struct(F.col("month").cast("int"),
                         F.struct(value("spend"), value("ad_sales"), value("impressions")))
        packed = F.map_from_entries(F.collect_list(entry)).alias("actuals")
        # An entity has as many rows as there are scenarios: nothing to spread.
        scen = attach(scen, (actuals.groupBy(*by) if by else actuals).agg(packed), by)

    rows = scen.withColumn("c", F.explode(calendar_rows()))
    rows = rows.withColumn("a", F.try_element_at("actuals", F.col("c.month")))
    spend, sales = F.col("a.spend"), F.col("a.ad_sales")
    grow = 1 + F.col("growth_pct") / 100

    def projected(actual: Column, annual: str) -> Column:
        seasonal = F.when(F.col(annual) > 0, F.col(annual) * F.col("c.weight"))
        return F.coalesce(rnd(actual * grow, 2), rnd(seasonal, 2), F.lit(0.0))

    rows = rows.withColumns({
        "projected_spend": projected(spend, "recommended_spend"),
        "projected_ad_sales": projected(sales, "target_ad_sales"),
    })
    both = (spend != 0) & (sales != 0)
    to_spend, to_sales = F.col("projected_spend"), F.col("projected_ad_sales")
    return rows.select(
        *by, "scenario_id", "c.month", "c.month_name",
        spend.alias("actual_spend"), sales.alias("actual_ad_sales"),
        F.when(both, positive_ratio(spend, sales, 2, 100.0)).alias("actual_acos_pct"),
        F.when(both, positive_ratio(sales, spend, 2)).alias("actual_roas"),
        F.col("a.impressions").alias("actual_impressions"),
        "projected_spend", "projected_ad_sales",
        positive_ratio(to_spend, to_sales, 2, 100.0).alias("projected_acos_pct"),
        positive_ratio(to_sales, to_spend, 2).alias("projected_roas"),
        "c.events", "c.is_event_month",
        F.rint((F.col("c.multiplier") - 1) * 100).alias("uplift_pct"),
        *[rnd(to_spend * F.lit(float(split.get(ch, 0.0))), 2).alias(name)
          for ch, name in CHANNEL_COLUMNS.items()],
    )


def plan_totals(months: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The monthly rows and one total row per entity and scenario (month is null there)."""
    keys = [*by, "scenario_id"]
    dollars = have(months, ["actual_spend", "actual_ad_sales", "projected_spend", "projected_ad_sales",
                            *CHANNEL_COLUMNS.values()])

    def exact(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast("decimal(28,6)")), F.lit(0)).cast("double").alias(name)

    sums = months.groupBy(*keys).agg(*[exact(d) for d in dollars])
    kinds = dict(months.dtypes)
    made = {
        "month_name": F.lit("TOTAL"), "events": F.lit("—"),
        "actual_acos_pct": positive_ratio(F.col("actual_spend"), F.col("actual_ad_sales"), 2, 100.0),
        "actual_roas": positive_ratio(F.col("actual_ad_sales"), F.col("actual_spend"), 2),
        "projected_acos_pct": positive_ratio(F.col("projected_spend"), F.col("projected_ad_sales"), 2, 100.0),
        "projected_roas": positive_ratio(F.col("projected_ad_sales"), F.col("projected_spend"), 2),
    }
    total_row = sums.select([
        F.col(c) if c in (*keys, *dollars) else made.get(c, F.lit(None).cast(kinds[c])).alias(c)
        for c in months.columns
    ])
    return months.unionByName(total_row)
