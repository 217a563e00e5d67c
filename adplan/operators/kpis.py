"""Account-level (or entity-level) key figures: one row per entity."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adplan.functions import labels
from adplan.functions.numeric import finite, have, positive_ratio, ratio, rnd, summable, total

ADS_TOTALS = {
    "impressions": "total_impressions",
    "clicks": "total_clicks",
    "spend": "total_spend",
    "ad_sales": "total_ad_sales",
    "ad_orders": "total_ad_orders",
    "ad_orders_ntb": "total_ad_orders_ntb",
    "sales_ntb": "total_ad_sales_ntb",
    "ad_sales_longterm": "total_ad_sales_longterm",
}
VENDOR_TOTALS = {
    "ordered_revenue": "total_ordered_revenue",
    "shipped_revenue": "total_shipped_revenue",
    "ordered_units": "total_ordered_units",
    "shipped_units": "total_shipped_units",
    "glance_views": "total_glance_views",
}


def _sum_all(df: DataFrame, names: dict[str, str], by: Sequence[str], wide: bool = False,
             more: Sequence[str] = (), derived: Mapping[str, Callable[[dict[str, Column]], Column]] | None = None) -> DataFrame:
    present = have(df, names)
    absent = [v for k, v in names.items() if k not in present]
    if wide or not (present or more):
        aggs = [total(df, n, wide=wide).alias(names[n]) for n in present] or [F.count(F.lit(1)).alias("__rows")]
        summed = (df.groupBy(*by) if by else df).agg(*aggs)
    else:
        rows, sums = summable(df, [*present, *more], by)
        extra = [f(sums).alias(n) for n, f in (derived or {}).items()]
        summed = (rows.groupBy(*by) if by else rows).agg(*[sums[n].alias(names[n]) for n in present], *extra)
    return summed.withColumns({v: F.lit(0.0) for v in absent}) if absent else summed


def ads_kpis(df: DataFrame, by: Sequence[str] = (), wide: bool = False) -> DataFrame:
    """Eight sums and the ratios over them. ``wide``: the rows are sums already."""
    s = _sum_all(df, ADS_TOTALS, by, wide=wide)
    spend, sales, clicks = F.col("total_spend"), F.col("total_ad_sales"), F.col("total_clicks")
    impressions, orders = F.col("total_impressions"), F.col("total_ad_orders")
    ntb, longterm = F.col("total_ad_orders_ntb"), F.col("total_ad_sales_longterm")

    def both(num: Column, den: Column, digits: int, scale: float | None = None) -> Column:
        return F.when((num > 0) & (den > 0), ratio(num, den, digits, scale))

    return s.select(
        *by, *ADS_TOTALS.values(),
        positive_ratio(spend, sales, 2, 100.0).alias("overall_acos"),
        both(sales, spend, 2).alias("overall_roas"),
        both(clicks, impressions, 4, 100.0).alias("overall_ctr"),
        positive_ratio(spend, clicks, 4).alias("overall_cpc"),
        both(orders, clicks, 2, 100.0).alias("conversion_rate"),
        both(ntb, orders, 1, 100.0).alias("ntb_order_pct"),
        both(longterm, spend, 2).alias("longterm_roas"),
        both(spend, orders, 2).alias("cost_per_order"),
    )


def vendor_kpis(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Five sums and the average selling price.

    The price is the plain mean of the price column when the report has one, else
    revenue per unit.
    """
    direct = "avg_selling_price" in df.columns
    if direct:
        price = F.col("avg_selling_price").cast("double")
        priced = df.withColumns({"avg_selling_price": price, "__priced": F.when(finite(price).isNotNull(), 1).otherwise(0).cast("long")})
        s = _sum_all(priced, VENDOR_TOTALS, by, more=["avg_selling_price", "__priced"],
                     derived={"__asp": lambda sums: F.try_divide(sums["avg_selling_price"], sums["__priced"])})
    else:
        s = _sum_all(df, VENDOR_TOTALS, by)
    revenue, units = F.col("total_ordered_revenue"), F.col("total_ordered_units")
    asp = rnd(F.col("__asp"), 2) if direct else F.when(
        (units > 0) & (revenue > 0), ratio(revenue, units, 2))
    return s.select(*by, *VENDOR_TOTALS.values(), asp.alias("avg_selling_price"))


def wasted_spend_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Spend on rows without an order, next to all spend."""
    if not {"ad_orders", "spend"} <= set(df.columns):
        raise ValueError("wasted_spend_summary needs ad_orders and spend")
    rows, sums = summable(df, ["spend"], by, {"wasted": ("spend", "coalesce(ad_orders, 0) = 0")})
    s = (rows.groupBy(*by) if by else rows).agg(sums["wasted"].alias("wasted"), sums["spend"].alias("spent"))
    return s.select(
        *by,
        rnd(F.col("wasted"), 2).alias("wasted_spend"),
        F.coalesce(positive_ratio(F.col("wasted"), F.col("spent"), 1, 100.0), F.lit(0.0)).alias("wasted_pct"),
        rnd(F.col("spent"), 2).alias("total_spend"),
    )


def account_health(kpis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Four checks of 25 points each; missing metrics earn nothing and have no status."""
    acos, roas = F.col("overall_acos"), F.col("overall_roas")
    ctr, cvr = F.col("overall_ctr"), F.col("conversion_rate")

    def points(c: Column, rungs: Column) -> Column:
        return F.when(c.isNotNull(), rungs).otherwise(F.lit(0))

    score = (points(acos, labels.ceiling_ladder(acos, [(20.0, 25), (35.0, 15)], 0))
             + points(roas, labels.ladder(roas, [(4.0, 25), (2.0, 15)], 0))
             + points(ctr, labels.ladder(ctr, [(0.5, 25), (0.3, 15)], 0))
             + points(cvr, labels.ladder(cvr, [(10.0, 25), (5.0, 15)], 0))).cast("double")

    def status(c: Column, rungs: Column) -> Column:
        return F.when(c.isNotNull(), rungs)

    return kpis.select(
        *by,
        score.alias("health_score"),
        labels.grade(score).alias("grade"),
        status(acos, labels.ceiling_ladder(acos, [(20.0, "Excellent"), (35.0, "Acceptable")], "High")).alias("acos_status"),
        status(roas, labels.ladder(roas, [(4.0, "Strong"), (2.0, "Adequate")], "Low")).alias("roas_status"),
        status(ctr, labels.ladder(ctr, [(0.5, "Strong"), (0.3, "Average")], "Low")).alias("ctr_status"),
        status(cvr, labels.ladder(cvr, [(10.0, "Excellent"), (5.0, "Average")], "Low")).alias("cvr_status"),
    ).filter("coalesce(acos_status, roas_status, ctr_status, cvr_status) is not null")


def _unpivot(kpis: DataFrame, by: Sequence[str], rows: list[dict[str, Column]]) -> DataFrame:
    """One output row per entry of ``rows`` and entity."""
    packed = F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])
    return kpis.select(*by, F.explode(packed).alias("r")).select(*by, "r.*")


def benchmark_scores(kpis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics and their benchmarks on a common scale from 0 to 100."""
    def scaled(c: Column, high: float, invert: bool = False) -> Column:
        s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), c / F.lit(high) * 100))
        return F.lit(100.0) - s if invert else s

    def value(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    cheapness = F.greatest(F.lit(0.0), F.lit(6.0) - value("overall_cpc"))
    plan = [  # metric, value, benchmark, top of the scale, lower is better
        ("ACOS efficiency", value("overall_acos"), 25.0, 60.0, True),
        ("ROAS", value("overall_roas"), 4.0, 8.0, False),
        ("CTR", value("overall_ctr"), 0.5, 1.0, False),
        ("CVR", value("conversion_rate"), 7.0, 20.0, False),
        ("CPC efficiency", cheapness, 3.0, 6.0, False),
    ]
    return _unpivot(kpis, by, [
        {"metric": F.lit(m), "score": scaled(v, top, inv), "benchmark_score": scaled(F.lit(b), top, inv)}
        for m, v, b, top, inv in plan
    ])


def kpi_scorecard(kpis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each known metric against its benchmark."""
    plan = [  # metric, column, benchmark, higher is better
        ("ACOS (%)", "overall_acos", 25.0, False),
        ("ROAS", "overall_roas", 4.0, True),
        ("CTR (%)", "overall_ctr", 0.35, True),
        ("CVR (%)", "conversion_rate", 7.0, True),
        ("CPC ($)", "overall_cpc", 3.0, False),
    ]
    rows = []
    for metric, name, limit, higher in plan:
        v = F.col(name)
        rows.append({
            "metric": F.lit(metric),
            "value": rnd(v, 2),
            "benchmark": F.lit(limit),
            "difference": rnd(v - F.lit(limit), 2),
            "on_target": (v >= limit) if higher else (v <= limit),
        })
    return _unpivot(kpis, by, rows).filter(F.col("value").isNotNull())


def baseline_check(kpis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recompute ACOS and ROAS from the sums and compare with the reported ones."""
    spend, sales = F.col("total_spend"), F.col("total_ad_sales")
    zero = F.lit(0.0)
    acos = positive_ratio(spend, sales, 2, 100.0)
    roas = positive_ratio(sales, spend, 2)

    def agrees(a: Column, b: str) -> Column:
        return F.abs(F.coalesce(a, zero) - F.coalesce(F.col(b), zero)) < 0.01

    return kpis.select(
        *by, acos.alias("acos_check"), roas.alias("roas_check"),
        agrees(acos, "overall_acos").alias("acos_ok"),
        agrees(roas, "overall_roas").alias("roas_ok"),
    )
