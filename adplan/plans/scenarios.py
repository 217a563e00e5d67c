"""Growth scenarios: from baselines to targets, spend, ratios and channel budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adplan.functions.numeric import above_zero, positive_ratio, rnd
from adplan.operators.attach import attach
from adplan.plans.settings import (
    ACOS_DECAY,
    DEFAULT_SPLIT,
    MAX_AD_SHARE,
    UNKNOWN_ACOS,
    UNKNOWN_AD_SHARE,
    Scenario,
    channel_rows,
    growth_scenarios,
    scenario_rows,
)


def baselines(kpis: DataFrame, vendor: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Revenue, spend and ad sales per entity, from advertising and vendor KPIs."""
    out = kpis.select(*by, F.col("total_spend").alias("spend"), F.col("total_ad_sales").alias("ad_sales"))
    if vendor is None:
        return out.withColumn("revenue", F.lit(0.0))
    known = vendor.select(*by, F.col("total_ordered_revenue").alias("revenue"))
    # One row per entity on both sides: nothing to spread.
    return attach(out, known, by).fillna(0.0, ["revenue"])


def forecast(base: DataFrame, scenarios: Sequence[Scenario] | None = None, by: Sequence[str] = (),
             target_acos: float | None = None) -> DataFrame:
    """One row per entity and scenario with its targets and projections.

    ``base`` has ``revenue``, ``spend`` and ``ad_sales``; a revenue of 0 means that ad
    sales are all the revenue there is. Pinned spend goes before pinned ROAS, and that
    before pinned TACOS.
    """
    scenarios = growth_scenarios() if scenarios is None else list(scenarios)
    nothing = F.lit(0.0)
    spend, sales, base_rev = F.col("spend"), F.col("ad_sales"), F.col("base_revenue")

    start = base.select(
        *by, "spend", "ad_sales",
        F.when(F.col("revenue") > 0, F.col("revenue")).otherwise(sales).alias("base_revenue"),
        F.explode(scenario_rows(scenarios)).alias("s"),
    ).select(*by, "spend", "ad_sales", "base_revenue", "s.*")

    pinned_rev = above_zero(F.col("pin_revenue"))
    target = start.withColumns({
        "growth_pct": F.when(
            pinned_rev.isNotNull() & (base_rev > 0),
            rnd((F.try_divide(pinned_rev, base_rev) - 1) * 100, 2)).otherwise(F.col("asked_growth_pct")),
        "target_revenue": F.coalesce(pinned_rev, base_rev * (1 + F.col("asked_growth_pct") / 100)),
    })

    share = F.when((base_rev > 0) & (sales > 0),
                   F.least(F.try_divide(sales, base_rev), F.lit(MAX_AD_SHARE))).otherwise(F.lit(UNKNOWN_AD_SHARE))
    gap = F.col("target_revenue") - base_rev
    target = target.withColumn(
        "target_ad_sales", F.coalesce(above_zero(F.col("pin_sales")), sales + gap * share))

    acos_now = F.try_divide(spend, above_zero(sales)) * 100
    worn = F.coalesce(F.nullif(acos_now, nothing), F.lit(UNKNOWN_ACOS)) * (1 + F.col("growth_pct") / 10 * ACOS_DECAY)
    effective = F.lit(float(target_acos)) if target_acos else worn
    goal = F.col("target_ad_sales")
    target = target.withColumn("recommended", F.coalesce(
        above_zero(F.col("pin_spend")),
        goal / above_zero(F.col("pin_roas")),
        F.col("target_revenue") * (above_zero(F.col("pin_tacos")) / 100),
        goal * (effective / 100),
    ))

    rev, rec = F.col("target_revenue"), F.col("recommended")
    organic = F.greatest(rev - goal, nothing)
    organic_now = F.greatest(base_rev - sales, nothing)

    def present(c: Column) -> Column:
        return F.nullif(c, nothing)

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, nothing)

    return target.select(
        *by, "scenario_id", "growth_pct", "is_custom",
        rnd(base_rev, 2).alias("baseline_revenue"),
        rnd(spend, 2).alias("current_ad_spend"),
        rnd(sales, 2).alias("current_ad_sales"),
        rnd(present(acos_now), 2).alias("current_acos_pct"),
        rnd(present(F.try_divide(spend, above_zero(base_rev)) * 100), 2).alias("current_tacos_pct"),
        rnd(present(F.try_divide(sales, above_zero(spend))), 2).alias("current_roas"),
        rnd(organic_now, 2).alias("baseline_organic_sales"),
        or_zero(positive_ratio(sales, base_rev, 1, 100.0)).alias("baseline_ad_contribution"),
        or_zero(positive_ratio(organic_now, base_rev, 1, 100.0)).alias("baseline_org_contribution"),
        rnd(rev, 2).alias("target_revenue"),
        rnd(gap, 2).alias("revenue_gap"),
        rnd(gap, 2).alias("incremental_revenue"),
        rnd(goal, 2).alias("target_ad_sales"),
        rnd(rec, 2).alias("recommended_spend"),
        rnd(rec - spend, 2).alias("incremental_spend"),
        or_zero(positive_ratio(rec, goal, 2, 100.0)).alias("projected_acos_pct"),
        positive_ratio(goal, rec, 2).alias("projected_roas"),
        positive_ratio(rec, rev, 2, 100.0).alias("projected_tacos_pct"),
        rnd(organic, 2).alias("projected_organic_sales"),
        or_zero(positive_ratio(goal, rev, 1, 100.0)).alias("projected_ad_contribution"),
        or_zero(positive_ratio(organic, rev, 1, 100.0)).alias("projected_org_contribution"),
        # Full precision, for what is derived further on.
        rec.alias("spend_exact"),
        (rec - spend).alias("incremental_exact"),
    )


def multi_scenario(base: DataFrame, percentages: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return forecast(base, growth_scenarios(percentages), by)


def normalise_split(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Channel weights of each entity as shares; the default split where all are 0.

    ``weights`` has the columns ``channel`` and ``weight``. An entity has one row per
    channel, so the known channels are summed into columns and no group is gathered.
    """
    w = F.col("weight").cast("decimal(28,12)")

    def summed(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("double").alias(name)

    channel = F.col("channel")
    per_channel = [summed(channel == c, f"w{i}") for i, c in enumerate(DEFAULT_SPLIT)]
    known = summed(channel.isin(*DEFAULT_SPLIT), "whole")
    wide = (weights.groupBy(*by) if by else weights).agg(*per_channel, known)
    rows = F.array(*[
        F.struct(F.lit(c).alias("channel"),
                 F.coalesce(F.try_divide(F.col(f"w{i}"), F.col("whole")), F.lit(d)).alias("weight"))
        for i, (c, d) in enumerate(DEFAULT_SPLIT.items())
    ])
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def channel_allocation(plan: DataFrame, split: Mapping[str, float] | None = None,
                       by: Sequence[str] = ()) -> DataFrame:
    """Budget, extra budget and share per scenario and channel."""
    rows = F.explode(channel_rows(split or DEFAULT_SPLIT)).alias("c")
    long = plan.select(*by, "scenario_id", "spend_exact", "incremental_exact", rows)
    w = F.col("c.weight")
    return long.select(
        *by, "scenario_id", "c.channel",
        rnd(F.col("spend_exact") * w, 2).alias("budget"),
        rnd(F.col("incremental_exact") * w, 2).alias("incremental_budget"),
        rnd(w * 100, 1).alias("share_pct"),
    )


def scenario_table(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The comparison columns of each scenario."""
    return plan.select(*by, "scenario_id", "growth_pct", "target_revenue", "revenue_gap", "recommended_spend",
                       "incremental_spend", "projected_acos_pct", "projected_roas", "projected_tacos_pct")


def what_if_table(plan: DataFrame, base: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The current state as a first row, then every scenario, in one shape."""
    zero = F.lit(0.0)

    def or_zero(name: str) -> Column:
        return F.coalesce(F.col(name), zero)

    projected = plan.select(
        *by, F.col("scenario_id").alias("scenario"), "target_revenue", "revenue_gap", "incremental_revenue",
        "recommended_spend", "incremental_spend", "target_ad_sales",
        F.col("projected_ad_contribution").alias("ad_contribution"),
        F.col("projected_organic_sales").alias("organic_sales"),
        F.col("projected_org_contribution").alias("org_contribution"),
        F.col("projected_acos_pct").alias("acos_pct"), or_zero("projected_roas").alias("roas"),
        or_zero("projected_tacos_pct").alias("tacos_pct"))
    spend, sales = F.col("spend"), F.col("ad_sales")
    rev = F.when(F.col("revenue") > 0, F.col("revenue")).otherwise(sales)
    organic = F.greatest(rev - sales, zero)
    current = base.select(
        *by, F.lit("current").alias("scenario"), rev.alias("target_revenue"), zero.alias("revenue_gap"),
        zero.alias("incremental_revenue"), spend.alias("recommended_spend"), zero.alias("incremental_spend"),
        sales.alias("target_ad_sales"),
        F.coalesce(positive_ratio(sales, rev, 1, 100.0), zero).alias("ad_contribution"),
        organic.alias("organic_sales"),
        F.coalesce(positive_ratio(organic, rev, 1, 100.0), zero).alias("org_contribution"),
        F.coalesce(positive_ratio(spend, sales, 2, 100.0), zero).alias("acos_pct"),
        F.coalesce(F.when(sales > 0, positive_ratio(sales, spend, 2)), zero).alias("roas"),
        F.coalesce(positive_ratio(spend, rev, 2, 100.0), zero).alias("tacos_pct"))
    return current.unionByName(projected)


def project_secondary(plan: DataFrame, kpis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Volumes scaled by the spend ratio; click price and rates stay as they are."""
    facts = kpis.select(*by, *[F.col(c) for c in (
        "total_spend", "total_clicks", "total_impressions", "total_ad_orders",
        "overall_cpc", "overall_ctr", "conversion_rate", "cost_per_order")])
    # An entity has as many rows as there are scenarios: nothing to spread.
    both = attach(plan.select(*by, "scenario_id", "recommended_spend"), facts, by)
    zero = F.lit(0.0)
    grow = F.when(F.col("total_spend") > 0, F.col("recommended_spend") / F.col("total_spend")).otherwise(1.0)
    orders = F.rint(F.col("total_ad_orders") * grow)
    return both.select(
        *by, "scenario_id",
        F.rint(F.col("total_clicks") * grow).alias("clicks"),
        F.rint(F.col("total_impressions") * grow).alias("impressions"),
        orders.alias("orders"),
        F.coalesce("overall_cpc", zero).alias("cpc"),
        F.coalesce("overall_ctr", zero).alias("ctr_pct"),
        F.coalesce("conversion_rate", zero).alias("cvr_pct"),
        F.coalesce(positive_ratio(F.col("recommended_spend"), orders, 2), F.col("cost_per_order"),
                   zero).alias("cost_per_order"),
    )


def pack_scenarios(plan: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The scenarios of an entity as one array, sized by the configured scenario list."""
    packed = F.collect_list(F.struct("scenario_id", *columns)).alias("scenarios")
    return (plan.groupBy(*by) if by else plan).agg(packed)
