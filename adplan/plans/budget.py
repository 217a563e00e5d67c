"""Where to put the money: campaign increases, reallocation, product plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adplan.functions.numeric import ratio, rnd
from adplan.operators.attach import attach, attach_totals
from adplan.operators.topk import top_n
from adplan.plans.scenarios import pack_scenarios


def _per_scenario(rows: DataFrame, plan: DataFrame, by: Sequence[str]) -> DataFrame:
    """Repeat a bounded set of rows per entity for each scenario of the entity."""
    packed = pack_scenarios(plan, ["incremental_exact", "incremental_spend"], by)
    keep = rows.columns
    return (attach(rows, packed, by)
            .withColumn("__s", F.explode("scenarios"))
            .select(*keep, "__s.scenario_id", "__s.incremental_exact", "__s.incremental_spend"))


def recommend_campaigns(campaigns: DataFrame, plan: DataFrame, name: str = "campaign_name",
                        by: Sequence[str] = (), n: int = 10) -> DataFrame:
    """Split each scenario's extra spend over campaigns by their efficiency.

    Weights come from all campaigns with a positive score; the ``n`` highest-spending of
    those are listed.
    """
    have_roas, have_acos = "roas" in campaigns.columns, "acos_pct" in campaigns.columns
    if have_roas:
        score = F.coalesce(F.col("roas"), F.lit(0.0))
    elif have_acos:
        score = F.coalesce(F.try_divide(F.lit(100.0), F.col("acos_pct")), F.lit(0.0))
    else:
        raise ValueError("campaigns need roas or acos_pct")
    scored = campaigns.withColumn("__score", score).filter(F.col("__score") > 0)
    whole = F.sum(F.col("__score").cast("decimal(28,6)")).cast("double")
    totals = (scored.groupBy(*by) if by else scored).agg(whole.alias("__whole"))
    head = attach(top_n(scored, "spend", n, [name], by), totals, by)
    null = F.lit(None).cast("double")
    slim = head.select(
        *by, F.col(name).alias("campaign"), rnd(F.col("spend"), 2).alias("current_spend"), F.col("spend").alias("__spend"),
        (F.col("__score") / F.col("__whole")).alias("__weight"),
        (rnd(F.col("roas"), 2) if have_roas else null).alias("roas"),
        (rnd(F.col("acos_pct"), 2) if have_acos else null).alias("acos_pct"))
    more = rnd(F.col("__weight") * F.col("incremental_exact"), 2)
    return _per_scenario(slim, plan, by).select(
        *by, "scenario_id", "campaign", "current_spend", more.alias("suggested_increase"),
        rnd(F.col("__spend") + more, 2).alias("new_budget"), "roas", "acos_pct")


def optimise_budget(campaigns: DataFrame, budget: float | str, name: str = "campaign_name",
                    by: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """Redistribute a budget over campaigns in proportion to ROAS x CVR / ACOS.

    ``budget`` is an amount, or the name of a column that holds each entity's amount, or
    ``"spend"`` to hand out again what is spent now. Campaigns without spend and sales
    get nothing; when no campaign is left, all get the same.
    """
    def value(c: str, missing: float, floor: float) -> Column:
        known = F.col(c) if c in campaigns.columns else F.lit(None).cast("double")
        return F.greatest(F.coalesce(known, F.lit(missing)), F.lit(floor))

    def amount(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) if c in campaigns.columns else F.lit(0.0)

    roas, cvr, acos = value("roas", 1.0, 0.1), value("cvr_pct", 5.0, 0.1), value("acos_pct", 30.0, 1.0)
    score = roas * cvr / acos
    if {"spend", "ad_sales"} <= set(campaigns.columns):
        score = F.when((amount("spend") == 0) & (amount("ad_sales") == 0), 0.0).otherwise(score)
    slim = campaigns.select(
        *by, F.col(name).alias("campaign"), amount("spend").alias("spend"), amount("ad_sales").alias("ad_sales"),
        roas.alias("roas"), acos.alias("acos_pct"), cvr.alias("cvr_pct"), score.alias("__eff"),
        *([F.col(budget).alias("__given")] if isinstance(budget, str) and budget != "spend" else []))
    sums = {
        "__sum": F.sum(F.col("__eff").cast("decimal(32,12)")).cast("double"),
        "__n": F.count(F.lit(1)).cast("double"),
    }
    if budget == "spend":
        sums["__given"] = rnd(F.sum(F.col("spend").cast("decimal(28,6)")).cast("double"), 2)
    df = attach_totals(slim, sums, by)
    given = F.col("__given") if isinstance(budget, str) else F.lit(float(budget))
    part = F.when(F.col("__sum") == 0, F.lit(1.0) / F.col("__n")).otherwise(F.col("__eff") / F.col("__sum"))
    shown = F.when(F.col("__sum") == 0, F.lit(1.0)).otherwise(F.col("__eff"))
    to = rnd(part * given, 2)
    now = rnd(F.col("spend"), 2)
    out = df.select(
        *by, "campaign", now.alias("current_spend"), rnd(F.col("ad_sales"), 2).alias("ad_sales"),
        rnd(F.col("roas"), 2).alias("roas"), rnd(F.col("acos_pct"), 2).alias("acos_pct"),
        rnd(F.col("cvr_pct"), 2).alias("cvr_pct"), rnd(shown, 3).alias("efficiency"),
        to.alias("optimised_budget"), rnd(to - now, 2).alias("delta"))
    return out.orderBy(F.col("efficiency").desc(), "campaign") if ordered else out


def moved(plan: DataFrame, direction: str) -> DataFrame:
    """Campaigns that gain, lose or keep their budget."""
    sign = {"gainers": F.col("delta") > 0, "losers": F.col("delta") < 0, "unchanged": F.col("delta") == 0}
    return plan.filter(sign[direction])


def reallocation_summary(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many campaigns gain, lose and stay, and how much money moves."""
    d = F.col("delta")

    def summed(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, d.cast("decimal(28,4)"))), F.lit(0)).cast("double")

    return (plan.groupBy(*by) if by else plan).agg(
        F.count_if(d > 0).alias("gainers"), summed(d > 0).alias("gained"),
        F.count_if(d < 0).alias("losers"), F.abs(summed(d < 0)).alias("lost"),
        F.count_if(d == 0).alias("unchanged"))


def spend_concentration(campaigns: DataFrame, k: int = 5, name: str = "campaign_name",
                        by: Sequence[str] = (), limit: float = 0.7) -> DataFrame:
    """Part of all spend that the ``k`` largest campaigns hold."""
    def summed(frame: DataFrame, alias: str) -> DataFrame:
        exact = F.sum(F.col("spend").cast("decimal(28,6)")).cast("double").alias(alias)
        return (frame.groupBy(*by) if by else frame).agg(exact)

    slim = campaigns.select(*by, name, "spend")
    out = attach(summed(slim, "total_spend"), summed(top_n(slim, "spend", k, [name], by), "top_spend"), by)
    share = ratio(F.col("top_spend"), F.col("total_spend"), 6)
    exact_share = F.try_divide(F.col("top_spend"), F.col("total_spend"))
    return out.select(*by, "top_spend", "total_spend", share.alias("top_share"),
                      F.coalesce((F.col("total_spend") > 0) & (exact_share > limit), F.lit(False)).alias("is_risk"))


def scenario_asin_plan(health: DataFrame, plan: DataFrame, by: Sequence[str] = (), n: int = 10) -> DataFrame:
    """Extra budget by score for the best products to scale and the best of those to pause."""
    whole = F.sum(F.col("score").cast("decimal(28,4)")).cast("double")
    totals = (health.groupBy(*by) if by else health).agg(whole.alias("__whole"))
    best = health.select(*by, "asin", "score", "tier").filter(F.col("tier").isin("Scale", "Pause"))
    head = attach(top_n(best, "score", n, ["asin"], [*by, "tier"]), totals, by)
    part = F.coalesce(F.try_divide(F.col("score"), F.col("__whole")), F.lit(0.0))
    return _per_scenario(head, plan, by).select(
        *by, "scenario_id", "tier", "asin", "score",
        rnd(part * F.col("incremental_spend"), 2).alias("incremental_budget"))
