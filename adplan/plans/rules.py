"""Threshold rules over one row of facts per entity: anomalies, actions, opportunities, narrative."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adplan.functions import labels
from adplan.functions.numeric import positive_ratio, ratio
from adplan.operators.attach import attach
from adplan.plans.budget import spend_concentration
from adplan.plans.settings import Scenario

# Limits of the key figures.
ACOS_EXCELLENT, ACOS_GOOD, ACOS_ACCEPTABLE = 20.0, 25.0, 35.0
ROAS_EXCELLENT, ROAS_GOOD, ROAS_ACCEPTABLE = 6.0, 4.0, 2.0
CTR_EXCELLENT, CTR_GOOD, CTR_LOW = 0.5, 0.35, 0.2
CVR_EXCELLENT, CVR_GOOD, CVR_LOW = 12.0, 7.0, 3.0
CPC_HIGH, CPC_VERY_HIGH = 3.0, 5.0
NTB_WEAK, NTB_STRONG = 20.0, 40.0
TACOS_HEALTHY, TACOS_WARNING = 10.0, 18.0

# Metric, its column, comparison, limit, severity.
ANOMALY_LIMITS = [
    ("ACOS", "overall_acos", ">", ACOS_ACCEPTABLE, "critical"),
    ("ACOS", "overall_acos", "<", 5.0, "warning"),
    ("ROAS", "overall_roas", "<", ROAS_ACCEPTABLE, "critical"),
    ("ROAS", "overall_roas", ">", 20.0, "warning"),
    ("CTR", "overall_ctr", "<", 0.1, "critical"),
    ("CVR", "conversion_rate", "<", 1.0, "critical"),
    ("CPC", "overall_cpc", ">", CPC_VERY_HIGH, "warning"),
]


def reference_scenario(scenarios: Sequence[Scenario]) -> str:
    """The +10 % scenario, or the first one."""
    return next((s.scenario_id for s in scenarios if s.growth_pct == 10), scenarios[0].scenario_id)


def campaign_facts(campaigns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of campaigns that are far off."""
    high = (F.col("acos_pct") > 80) & (F.col("spend") > 100)
    none = (F.coalesce(F.col("roas"), F.lit(0.0)) == 0) & (F.col("spend") > 50)
    return (campaigns.groupBy(*by) if by else campaigns).agg(
        F.count_if(high).alias("high_acos_campaigns"), F.count_if(none).alias("zero_roas_campaigns"))


def tier_facts(health: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Products and spend of the best and the worst tier."""
    def spend_of(t: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("spend").cast("decimal(28,6)"))),
                          F.lit(0)).cast("double")

    return (health.groupBy(*by) if by else health).agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("tier") == "Scale").alias("scale_products"), spend_of("Scale").alias("scale_spend"),
        F.count_if(F.col("tier") == "Pause").alias("pause_products"), spend_of("Pause").alias("pause_spend"))


def account_facts(kpis: DataFrame, vendor: DataFrame | None = None, campaigns: DataFrame | None = None,
                  health: DataFrame | None = None, plan: DataFrame | None = None,
                  scenario_id: str | None = None, waste: DataFrame | None = None,
                  by: Sequence[str] = (), campaign: str = "campaign_name") -> DataFrame:
    """Everything the rules look at, one row per entity; absent inputs leave nulls."""
    def null(kind: str) -> Column:
        return F.lit(None).cast(kind)

    def add(facts: DataFrame, more: DataFrame | None, kinds: dict[str, str]) -> DataFrame:
        if more is None:
            return facts.withColumns({c: null(k) for c, k in kinds.items()})
        return attach(facts, more.select(*by, *kinds), by)

    facts = add(kpis, vendor, {"total_ordered_revenue": "double"})
    facts = add(facts, None if campaigns is None else campaign_facts(campaigns, by),
                {"high_acos_campaigns": "bigint", "zero_roas_campaigns": "bigint"})
    facts = add(facts, None if campaigns is None else spend_concentration(campaigns, name=campaign, by=by),
                {"is_risk": "boolean", "top_share": "double"})
    facts = add(facts, None if health is None else tier_facts(health, by),
                {"products": "bigint", "scale_products": "bigint", "scale_spend": "double",
                 "pause_products": "bigint", "pause_spend": "double"})
    if plan is not None:
        plan = plan.filter(F.col("scenario_id") == scenario_id) if scenario_id else plan
    facts = add(facts, plan, {"growth_pct": "double", "target_revenue": "double", "revenue_gap": "double",
                              "recommended_spend": "double", "incremental_spend": "double",
                              "projected_roas": "double"})
    facts = add(facts, waste, {"wasted_spend": "double"})
    zero = F.lit(0.0)
    rev = F.coalesce(F.nullif(F.col("total_ordered_revenue"), zero), F.col("total_ad_sales"), zero)
    return facts.withColumn("revenue", rev).withColumn(
        "tacos_pct", positive_ratio(F.col("total_spend"), F.col("revenue"), 2, 100.0))


def emit(facts: DataFrame, by: Sequence[str], rules: Sequence[tuple[Column, dict[str, Column]]],
         otherwise: dict[str, Column] | None = None) -> DataFrame:
    """One row per rule that holds, in one pass over the facts."""
    def row(fields: dict[str, Column]) -> Column:
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    hits = F.filter(F.array(*[F.when(cond, row(fields)) for cond, fields in rules]), lambda r: r.isNotNull())
    if otherwise is not None:
        hits = F.when(F.size(hits) == 0, F.array(row(otherwise))).otherwise(hits)
    return facts.select(*by, F.explode(hits).alias("r")).select(*by, "r.*")


def _known(name: str) -> Column:
    """A metric, with 0 read as unknown."""
    return F.nullif(F.col(name), F.lit(0.0))


def threshold_checks(limits=ANOMALY_LIMITS) -> list[tuple[Column, dict[str, Column]]]:
    out = []
    for metric, name, op, limit, severity in limits:
        v = _known(name)
        out.append((v > limit if op == ">" else v < limit, {
            "metric": F.lit(metric), "severity": F.lit(severity), "value": v, "limit": F.lit(limit),
            "message": F.format_string(f"{metric} is %.2f ({op} {limit:g})", v)}))
    return out


def threshold_hits(kpis: DataFrame, limits=ANOMALY_LIMITS, by: Sequence[str] = ()) -> DataFrame:
    """Metrics on the wrong side of their limits."""
    return emit(kpis, by, threshold_checks(limits))


METRICS = {"ACOS": "overall_acos", "ROAS": "overall_roas", "CTR": "overall_ctr", "CVR": "conversion_rate", "CPC": "overall_cpc"}


def limit_table(spark: SparkSession, limits=ANOMALY_LIMITS) -> DataFrame:
    """The given limits as a table: metric, op (> or <), limit, severity."""
    return spark.createDataFrame([(m, op, float(x), sev) for m, _, op, x, sev in limits], "metric string, op string, limit double, severity string")


def limit_hits(kpis: DataFrame, limits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics on the wrong side of limits that come from a table: metric, op, limit, severity and, where the
    table has them, the entity columns.

    A limit of an entity replaces the default (null in the entity columns) of its metric, op and severity. Metrics
    are rows here and meet their limits by name; a limit is per metric or entity, so no metric row meets more than
    its own. A metric of 0 or null hits nothing; neither does a null limit, which switches a default off.
    """
    own = [k for k in by if k in limits.columns]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.nullif(F.col(c), F.lit(0.0)).alias("value")) for m, c in METRICS.items() if c in kpis.columns]))
    values = kpis.select(*by, cells.alias("m")).select(*by, "m.*").filter("value is not null")
    rule = ["metric", "op", "severity"]
    default = limits.filter(" and ".join([f"`{k}` is null" for k in own]) or "true").select(*rule, F.col("limit").alias("usual"))
    pairs = values.join(default, "metric")
    if own:
        exact = limits.filter(" and ".join(f"`{k}` is not null" for k in own)).select(*own, *rule, F.col("limit").alias("special"), F.lit(True).alias("found"))
        # A full join, as an entity may have a limit of a kind that has no default.
        wanted = exact.join(values, [*own, "metric"]).select(*by, *rule, "value", "special", "found")
        same = [*by, *rule]
        pairs = pairs.alias("p").join(wanted.alias("w"), [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in same], "full").select(
            *[F.coalesce(f"p.{k}", f"w.{k}").alias(k) for k in same], F.coalesce("p.value", "w.value").alias("value"),
            F.when(F.col("w.found"), F.col("w.special")).otherwise(F.col("p.usual")).alias("limit"))
    else:
        pairs = pairs.withColumnRenamed("usual", "limit")
    wrong = ((F.col("op") == ">") & (F.col("value") > F.col("limit"))) | ((F.col("op") == "<") & (F.col("value") < F.col("limit")))
    return pairs.filter(wrong).select(*by, "metric", "severity", "value", "limit")


def anomalies(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Limit violations of the key figures and counts of campaigns that are far off."""
    def counted(metric: str, name: str, limit: float, text: str):
        n = F.col(name)
        return (n > 0, {"metric": F.lit(metric), "severity": F.lit("critical"), "value": n.cast("double"),
                        "limit": F.lit(limit), "message": F.format_string(text, n)})

    rules = threshold_checks() + [
        counted("Campaign ACOS", "high_acos_campaigns", 80.0, "%d campaigns spend over 100 at an ACOS above 80 %%"),
        counted("Zero ROAS Campaigns", "zero_roas_campaigns", 0.0, "%d campaigns spend over 50 without any sale"),
    ]
    null = F.lit(None).cast("double")
    return emit(facts, by, rules, {
        "metric": F.lit("All Clear"), "severity": F.lit("ok"), "value": null, "limit": null,
        "message": F.lit("All key figures are inside their limits")})


def actions(facts: DataFrame, by: Sequence[str] = (), n: int = 10) -> DataFrame:
    """Recommended actions in order of priority, at most ``n`` per entity."""
    acos, roas, ctr = _known("overall_acos"), _known("overall_roas"), _known("overall_ctr")
    cvr, cpc, ntb = _known("conversion_rate"), _known("overall_cpc"), _known("ntb_order_pct")
    tacos, waste = _known("tacos_pct"), F.col("pause_spend")
    always, none = F.lit(True), F.lit(None).cast("double")
    quick, weeks, month = "Quick Win", "1–2 weeks", "1+ month"
    # Limits, priorities, impact and effort of the actions.
    plan = [  # rule, condition, priority, impact, effort, category, value, title
        ("reduce_acos", acos > ACOS_ACCEPTABLE, 1, "High", quick, "Efficiency", acos, "Bring ACOS of %.1f %% under 35 %%"),
        ("lift_roas", roas < ROAS_ACCEPTABLE, 1, "High", quick, "Efficiency", roas, "Lift ROAS of %.2f to at least 2"),
        ("fix_ctr", ctr < CTR_LOW, 2, "High", weeks, "Creative", ctr, "Renew main images: CTR is only %.2f %%"),
        ("lift_ctr", (ctr >= CTR_LOW) & (ctr < CTR_GOOD), 4, "Medium", weeks, "Creative", ctr, "Try new creatives: CTR of %.2f %% is under 0.35 %%"),
        ("fix_cvr", cvr < CVR_LOW, 2, "High", month, "Listing", cvr, "Rework listings: %.1f %% of clicks convert"),
        ("cut_cpc", cpc > CPC_VERY_HIGH, 2, "High", quick, "Bidding", cpc, "Cut bids: a click costs %.2f"),
        ("watch_cpc", (cpc > CPC_HIGH) & (cpc <= CPC_VERY_HIGH), 5, "Medium", quick, "Bidding", cpc, "Watch bids: a click costs %.2f"),
        ("reduce_tacos", tacos > TACOS_WARNING, 3, "High", month, "Strategy", tacos, "Build organic sales: TACOS is %.1f %%"),
        ("scale_budget", (acos <= ACOS_EXCELLENT) & (F.col("total_spend") > 0), 3, "High", quick, "Scale", acos, "Raise budgets: ACOS of %.1f %% leaves room"),
        ("grow_ntb", ntb < NTB_WEAK, 6, "Medium", weeks, "Acquisition", ntb, "Reach new shoppers: %.0f %% of orders are new to brand"),
        ("keep_ntb", ntb >= NTB_STRONG, 7, "Medium", weeks, "Retention", ntb, "Bring new buyers back: %.0f %% of orders are new to brand"),
        ("pause_products", (F.col("pause_products") > 0) & (waste > 500), 2, "High", quick, "Portfolio", waste, "Pause weak products and free %.0f of spend"),
        ("spread_budget", F.col("is_risk"), 5, "Medium", weeks, "Risk", F.col("top_share"), "Spread the budget: five campaigns hold %.2f of it"),
        ("harvest_terms", always, 8, "High", quick, "Optimisation", none, "Move winning search terms to exact match"),
        ("preload_events", always, 9, "High", weeks, "Seasonal", none, "Raise budgets three weeks before peak events"),
    ]
    rows = [
        F.when(cond, F.struct(
            F.lit(priority).alias("priority"), F.lit(i).alias("ordinal"), F.lit(rule).alias("rule"),
            F.lit(impact).alias("impact"), F.lit(effort).alias("effort"), F.lit(category).alias("category"),
            value.cast("double").alias("value"),
            (F.format_string(title, value) if "%" in title else F.lit(title)).alias("title")))
        for i, (rule, cond, priority, impact, effort, category, value, title) in enumerate(plan, start=1)
    ]
    held = F.filter(F.array(*rows), lambda r: r.isNotNull())
    # Priority and ordinal lead the struct, so sorting the array is a stable sort by priority.
    first = F.slice(F.array_sort(held), 1, n)
    return (facts.select(*by, F.posexplode(first).alias("pos", "r"))
            .select(*by, (F.col("pos") + 1).alias("place"), "r.priority", "r.rule", "r.impact", "r.effort",
                    "r.category", "r.value", "r.title"))


def opportunities(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Money estimates. ``measured`` is the waste found in the report, where the facts have it."""
    zero = F.lit(0.0)
    spend, roas = F.coalesce("total_spend", zero), F.coalesce("overall_roas", zero)
    none = F.lit(None).cast("double")
    waste = spend * 0.12
    extra = F.col("scale_spend") * 0.25
    extra_sales = F.when(roas > 0, extra * roas).otherwise(extra * 3)
    pause = F.col("pause_spend")
    gap = F.col("revenue_gap")
    video = spend * 0.25 * 0.30

    def fields(rule: str, kind: str, amount: Column, title: str, measured: Column = none):
        return {"rule": F.lit(rule), "type": F.lit(kind), "amount": F.rint(amount),
                "measured": measured, "title": F.format_string(title, amount)}

    return emit(facts, by, [
        (waste > 500, fields("recover_waste", "Save", waste, "About %.0f of spend brings no order", F.col("wasted_spend"))),
        ((F.col("scale_products") > 0) & (extra > 200),
         fields("scale_winners", "Grow", extra_sales, "A quarter more on the best products could sell %.0f")),
        ((pause > 500) & (roas > 0),
         fields("reallocate_pause", "Optimise", pause * roas - pause, "Moving spend off weak products could add %.0f")),
        (gap > 0, fields("growth_gap", "Grow", gap, "The growth target is worth %.0f of revenue")),
        ((_known("overall_ctr") < CTR_GOOD) & (video > 1000),
         fields("brand_video", "Grow", video, "Video ads could add %.0f of sales")),
    ])


def opportunity_totals(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Growth and savings sums, and the number of opportunities."""
    def summed(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("amount").cast("decimal(28,2)"))),
                          F.lit(0)).cast("double")

    return (found.groupBy(*by) if by else found).agg(
        summed("Grow").alias("grow_total"), summed("Save").alias("save_total"), F.count(F.lit(1)).alias("found"))


def narrative_facts(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Up to five paragraphs per entity: subject, sentiment, leading figure and a sentence."""
    zero = F.lit(0.0)
    spend, rev = F.coalesce("total_spend", zero), F.col("revenue")
    acos, roas, ctr = _known("overall_acos"), F.col("overall_roas"), F.col("overall_ctr")
    shown, clicked = F.coalesce("total_impressions", zero), F.coalesce("total_clicks", zero)
    tacos = _known("tacos_pct")
    products, pause = F.col("products"), F.col("pause_products")

    efficient = F.when(acos <= ACOS_GOOD, "positive").when(acos <= ACOS_ACCEPTABLE, "neutral").otherwise("warning")
    returns = labels.ladder(roas, [(ROAS_GOOD, "positive"), (ROAS_ACCEPTABLE, "neutral")], "critical")
    clicks = F.when(ctr.isNull(), "neutral").otherwise(
        labels.ladder(ctr, [(CTR_EXCELLENT, "positive"), (CTR_GOOD, "neutral")], "warning"))
    portfolio = F.when(pause == 0, "positive").when(pause <= products * 0.2, "warning").otherwise("critical")
    dependence = labels.ceiling_ladder(tacos, [(TACOS_HEALTHY, "healthy"), (TACOS_WARNING, "dependent")], "critical")

    def paragraph(no: int, subject: str, sentiment: Column, value: Column, body: Column, note: Column | None = None):
        return {"paragraph": F.lit(no), "subject": F.lit(subject), "sentiment": sentiment,
                "value": value.cast("double"), "note": F.lit(None).cast("string") if note is None else note,
                "body": body}

    return emit(facts, by, [
        ((spend > 0) & (rev > 0), paragraph(
            1, "overview", efficient, acos,
            F.format_string("Revenue of %.0f on ad spend of %.0f; ads bring %.1f %% of it.", rev, spend,
                            ratio(F.col("total_ad_sales"), rev, 1, 100.0)),
            F.when(tacos.isNotNull(), dependence))),
        (roas.isNotNull(), paragraph(
            2, "efficiency", returns, roas, F.format_string("Each unit of ad spend returns %.2f.", roas),
            F.when(F.col("conversion_rate").isNotNull(), labels.ladder(
                F.col("conversion_rate"), [(CVR_EXCELLENT, "converts well"), (CVR_GOOD, "converts soundly")],
                "converts poorly")))),
        ((shown > 0) & (clicked > 0), paragraph(
            3, "visibility", clicks, ctr,
            F.format_string("%.0f impressions led to %.0f clicks.", shown, clicked),
            F.when(_known("ntb_order_pct").isNotNull(), labels.ladder(
                F.col("ntb_order_pct"), [(NTB_STRONG, "strong acquisition")], "moderate acquisition")))),
        (F.col("target_revenue").isNotNull(), paragraph(
            4, "growth", F.lit("neutral"), F.col("incremental_spend"),
            F.format_string("Reaching %.0f takes %.0f more ad spend.", F.col("target_revenue"),
                            F.col("incremental_spend")))),
        (products > 0, paragraph(
            5, "portfolio", portfolio, F.col("pause_spend"),
            F.format_string("%d of %d products are strong, %d are weak.", F.col("scale_products"), products, pause))),
    ])


def health_alerts(kpis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Short list of what is wrong (``alert``) and what is right (``good``)."""
    acos, roas, ctr = F.col("overall_acos"), F.col("overall_roas"), F.col("overall_ctr")
    cpc, ntb = F.col("overall_cpc"), F.col("ntb_order_pct")
    # Limits, priorities, impact and effort of the actions.
    plan = [  # rule, condition, kind, value
        ("acos_high", acos > 35, "alert", acos),
        ("acos_low", acos < 15, "good", acos),
        ("acos_healthy", (acos >= 15) & (acos <= 35), "good", acos),
        ("roas_low", roas < 2, "alert", roas),
        ("roas_strong", roas >= 4, "good", roas),
        ("ctr_low", ctr < 0.3, "alert", ctr),
        ("cpc_high", cpc > 2.5, "alert", cpc),
        ("ntb_strong", ntb > 50, "good", ntb),
    ]
    return emit(kpis, by, [
        (cond, {"rule": F.lit(rule), "kind": F.lit(kind), "value": value}) for rule, cond, kind, value in plan])
