"""SQL over the same tables, written on its own from the definitions of the operators.

Every statement names the intermediate tables it needs; :func:`sql` puts the closure of
their definitions in front.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}
ORACLES: dict[str, str] = {}

CORE = ["spend", "ad_sales", "impressions", "clicks", "ad_orders"]
FULL = [*CORE, "ad_orders_ntb", "ad_sales_longterm"]
VENDOR = ["ordered_revenue", "shipped_revenue", "ordered_units", "shipped_units"]
PRODUCTS3 = ("Sponsored Products", "Sponsored Brands", "Sponsored Display")


def r(x: str, digits: int) -> str:
    """Half-even rounding of a double."""
    if digits == 0:
        return f"round_even({x}, 0)"
    return f"(round_even(({x}) * {10**digits}, 0) / {10**digits})"


def ratio(a: str, b: str, digits: int, pct: bool = False) -> str:
    return r(f"({a}) / nullif({b}, 0)" + (" * 100" if pct else ""), digits)


def pos(a: str, b: str, digits: int, pct: bool = False) -> str:
    return f"CASE WHEN ({b}) > 0 THEN {ratio(a, b, digits, pct)} END"


def s(name: str, where: str | None = None) -> str:
    inner = name if where is None else f"CASE WHEN {where} THEN {name} END"
    return f"CAST(coalesce(sum({inner}), 0) AS DOUBLE)"


def sums(names: list[str]) -> str:
    return ", ".join(f"{s(n)} AS {n}" for n in names)


RATIOS = ", ".join([
    ratio("spend", "ad_sales", 2, True) + " AS acos_pct", ratio("ad_sales", "spend", 2) + " AS roas",
    ratio("spend", "clicks", 4) + " AS cpc", ratio("ad_orders", "clicks", 2, True) + " AS cvr_pct"])
NTB = ratio("ad_orders_ntb", "ad_orders", 1, True) + " AS ntb_pct"


def grouped(keys: str, names: list[str], source: str = "ads", where: str = "true", more: str = "") -> str:
    return f"SELECT {keys}, {sums(names)}{more} FROM {source} WHERE {where} GROUP BY {keys}"


def sql(text: str) -> str:
    """Put the definitions of the parts a statement uses, and of theirs, in front of it."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name, definition in PARTS.items():
            if name not in needed and re.search(rf"(FROM|JOIN) {name}\b", body):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(text)
    if not needed:
        return text
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in needed) + "\n" + text


def oracle(name: str, text: str) -> None:
    ORACLES[name] = sql(text)


def union(rows: list[str]) -> str:
    return "\nUNION ALL ".join(rows)


# --- parts: the two reports ---------------------------------------------------------------

SOLD = "l_linestatus = 'F' AND p_size % 10 <> 0"
NEW = f"{SOLD} AND (o_orderstatus = 'P' OR p_size % 3 = 0)"


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,4))"


PARTS["ads"] = f"""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS report_date,
 printf('B%09d', l_partkey) AS asin, 'camp-' || CAST(l_suppkey AS VARCHAR) AS campaign_name,
 CASE l_returnflag WHEN 'R' THEN 'Sponsored Products' WHEN 'A' THEN 'Sponsored Brands'
  ELSE 'Sponsored Display' END AS campaign_type,
 CASE l_linenumber % 3 WHEN 0 THEN 'Exact' WHEN 1 THEN 'Phrase' ELSE 'Broad' END AS match_type,
 o_orderpriority AS bid_strategy, p_name || ' ' || CAST(p_size AS VARCHAR) AS search_term,
 p_name AS product_title, p_type AS category, p_brand AS brand,
 {dec("l_quantity * 100 * (1 + l_linenumber)")} AS impressions,
 {dec("ceil(l_quantity / (1 + p_size % 8))")} AS clicks,
 {dec("l_extendedprice * l_discount * (1 + p_size % 7)")} AS spend,
 {dec(f"CASE WHEN {SOLD} THEN l_extendedprice ELSE 0 END")} AS ad_sales,
 {dec(f"CASE WHEN {SOLD} THEN 1 ELSE 0 END")} AS ad_orders,
 {dec(f"CASE WHEN {NEW} THEN 1 ELSE 0 END")} AS ad_orders_ntb,
 {dec(f"CASE WHEN {NEW} THEN l_extendedprice ELSE 0 END")} AS sales_ntb,
 {dec(f"CASE WHEN {SOLD} THEN l_extendedprice * (1 + l_tax) ELSE 0 END")} AS ad_sales_longterm
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""

PARTS["ven"] = f"""SELECT printf('B%09d', l_partkey) AS asin, CAST(l_shipdate AS DATE) AS report_date,
 p_name AS product_title, p_type AS category, p_brand AS brand,
 {dec("l_extendedprice")} AS ordered_revenue, {dec("l_extendedprice * (1 - l_discount)")} AS shipped_revenue,
 {dec("l_quantity")} AS ordered_units,
 {dec("CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END")} AS shipped_units,
 {dec("l_quantity * 20")} AS glance_views, {dec("p_retailprice")} AS list_price
 FROM lineitem JOIN part ON l_partkey = p_partkey"""

# --- parts: key figures ------------------------------------------------------------------------

KPI_SUMS = {"impressions": "total_impressions", "clicks": "total_clicks", "spend": "total_spend",
            "ad_sales": "total_ad_sales", "ad_orders": "total_ad_orders", "ad_orders_ntb": "total_ad_orders_ntb",
            "sales_ntb": "total_ad_sales_ntb", "ad_sales_longterm": "total_ad_sales_longterm"}


def both(a: str, b: str, digits: int, pct: bool = False) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN {ratio(a, b, digits, pct)} END"


def kpi(by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    inner = ", ".join(f"{s(k)} AS {v}" for k, v in KPI_SUMS.items())
    return f"""SELECT *, {pos("total_spend", "total_ad_sales", 2, True)} AS overall_acos,
 {both("total_ad_sales", "total_spend", 2)} AS overall_roas,
 {both("total_clicks", "total_impressions", 4, True)} AS overall_ctr,
 {pos("total_spend", "total_clicks", 4)} AS overall_cpc,
 {both("total_ad_orders", "total_clicks", 2, True)} AS conversion_rate,
 {both("total_ad_orders_ntb", "total_ad_orders", 1, True)} AS ntb_order_pct,
 {both("total_ad_sales_longterm", "total_spend", 2)} AS longterm_roas,
 {both("total_spend", "total_ad_orders", 2)} AS cost_per_order
 FROM (SELECT {head}{inner} FROM ads{tail})"""


VKPI_SUMS = {n: f"total_{n}" for n in [*VENDOR, "glance_views"]}


def vkpi(by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    inner = ", ".join(f"{s(k)} AS {v}" for k, v in VKPI_SUMS.items())
    return f"""SELECT *, {both("total_ordered_revenue", "total_ordered_units", 2)} AS avg_selling_price
 FROM (SELECT {head}{inner} FROM ven{tail})"""


PARTS["kpi"] = kpi()
PARTS["kpi_brand"] = kpi("brand")
PARTS["kpi_asin"] = kpi("asin")
PARTS["vkpi"] = vkpi()
PARTS["vkpi_brand"] = vkpi("brand")
PARTS["vkpi_asin"] = vkpi("asin")

# --- parts: breakdowns ---------------------------------------------------------------------------

PARTS["camp"] = f"SELECT *, {RATIOS} FROM ({grouped('campaign_name', CORE)})"
PARTS["camp_brand"] = f"SELECT *, {RATIOS} FROM ({grouped('brand, campaign_name', CORE)})"
PARTS["asin_ads"] = f"SELECT *, {RATIOS} FROM ({grouped('asin', CORE)})"
PARTS["asin_ven"] = f"""SELECT *, {ratio("ordered_revenue", "ordered_units", 2)} AS avg_price FROM (
 {grouped('asin', VENDOR, 'ven', more=', min(product_title) AS product_title, min(category) AS category, min(brand) AS brand')})"""
PARTS["terms"] = f"SELECT *, {RATIOS}, {NTB} FROM ({grouped('search_term', FULL)})"
PARTS["prod"] = f"""SELECT *, {RATIOS}, {NTB} FROM (
 {grouped('asin', FULL, more=', min(product_title) AS product_title, min(category) AS category, min(brand) AS brand')})"""
PARTS["prod_brand"] = f"SELECT *, {RATIOS}, {NTB} FROM ({grouped('brand, asin', FULL)})"
PARTS["merged"] = f"""SELECT coalesce(a.asin, v.asin) AS asin, a.* EXCLUDE (asin), v.* EXCLUDE (asin),
 {ratio("a.spend", "v.ordered_revenue", 2, True)} AS tacos_pct
 FROM asin_ads a FULL OUTER JOIN asin_ven v ON a.asin = v.asin"""

# --- parts: health ---------------------------------------------------------------------------------


def scored(source: str, by: str = "") -> str:
    over = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, CASE WHEN score >= 80 THEN 'Scale' WHEN score >= 55 THEN 'Optimise'
  WHEN score >= 35 THEN 'Review' ELSE 'Pause' END AS tier FROM (
 SELECT * EXCLUDE (q1, q3), CAST(
  CASE WHEN coalesce(roas, 0) >= 6 THEN 30 WHEN coalesce(roas, 0) >= 4 THEN 22 WHEN coalesce(roas, 0) >= 2 THEN 12 ELSE 0 END
  + CASE WHEN coalesce(acos_pct, 999) < 15 THEN 25 WHEN coalesce(acos_pct, 999) < 25 THEN 18
     WHEN coalesce(acos_pct, 999) < 35 THEN 10 ELSE 0 END
  + CASE WHEN coalesce(cvr_pct, 0) >= 15 THEN 20 WHEN coalesce(cvr_pct, 0) >= 10 THEN 15 WHEN coalesce(cvr_pct, 0) >= 5 THEN 8 ELSE 0 END
  + CASE WHEN coalesce(ntb_pct, 0) >= 60 THEN 15 WHEN coalesce(ntb_pct, 0) >= 40 THEN 10 WHEN coalesce(ntb_pct, 0) >= 20 THEN 5 ELSE 0 END
  + CASE WHEN impressions >= q3 THEN 10 WHEN impressions >= q1 THEN 6 ELSE 2 END AS DOUBLE) AS score
 FROM (SELECT *, quantile_cont(impressions, 0.25) OVER ({over}) AS q1,
  quantile_cont(impressions, 0.75) OVER ({over}) AS q3 FROM {source}))"""


PARTS["scored"] = scored("prod")
PARTS["scored_brand"] = scored("prod_brand", "brand")
PARTS["health"] = """SELECT h.*, v.ordered_revenue, v.shipped_revenue, v.ordered_units
 FROM scored h LEFT JOIN asin_ven v ON h.asin = v.asin"""

# --- parts: time --------------------------------------------------------------------------------------

TREND_RATIOS = ", ".join([
    ratio("spend", "ad_sales", 2, True) + " AS acos_pct", ratio("ad_sales", "spend", 2) + " AS roas",
    ratio("spend", "clicks", 4) + " AS cpc", ratio("clicks", "impressions", 4, True) + " AS ctr_pct"])


def trend(unit: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    return f"""SELECT *, {TREND_RATIOS} FROM (SELECT {head}CAST(date_trunc('{unit}', report_date) AS DATE) AS period_start,
 {sums(CORE)} FROM ads GROUP BY ALL)"""


def actuals(source: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    both_set = "spend <> 0 AND ad_sales <> 0"
    return f"""SELECT *, CASE WHEN {both_set} THEN {ratio("spend", "ad_sales", 2, True)} END AS acos_pct,
 CASE WHEN {both_set} THEN {ratio("ad_sales", "spend", 2)} END AS roas
 FROM (SELECT {head}CAST(year(period_start) AS INTEGER) AS year, CAST(month(period_start) AS INTEGER) AS month,
  {", ".join(f"CAST(sum({dec(c)}) AS DOUBLE) AS {c}" for c in CORE)} FROM {source} GROUP BY ALL)
 QUALIFY year = max(year) OVER ({over})"""


PARTS["monthly"] = trend("month")
PARTS["monthly_brand"] = trend("month", "brand")
PARTS["monthly_asin"] = trend("month", "asin")
PARTS["actual"] = actuals("monthly")
PARTS["actual_brand"] = actuals("monthly_brand", "brand")
PARTS["actual_asin"] = actuals("monthly_asin", "asin")

# --- parts: scenarios -------------------------------------------------------------------------------------


def base(by: str = "") -> str:
    if not by:
        return """SELECT total_spend AS spend, total_ad_sales AS ad_sales,
 coalesce((SELECT total_ordered_revenue FROM vkpi), 0) AS revenue FROM kpi"""
    return f"""SELECT k.{by}, k.total_spend AS spend, k.total_ad_sales AS ad_sales,
 coalesce(v.total_ordered_revenue, 0) AS revenue FROM kpi_{by} k LEFT JOIN vkpi_{by} v USING ({by})"""


GROWTH = [(f"+{g}%", g, *["NULL"] * 5) for g in (10, 20, 30)]
PINS = [
    ("pin_revenue", 0, "3.0e9", "NULL", "NULL", "NULL", "NULL"),
    ("pin_spend", 0, "NULL", "2.0e8", "NULL", "NULL", "NULL"),
    ("pin_sales", 0, "NULL", "NULL", "9.0e8", "NULL", "NULL"),
    ("pin_roas", 5, "NULL", "NULL", "NULL", "6.0", "NULL"),
    ("pin_tacos", 5, "NULL", "NULL", "NULL", "NULL", "8.0"),
    ("pin_spend_and_roas", 0, "NULL", "1.0e8", "NULL", "6.0", "8.0"),
]


def forecast(base_name: str, by: str = "", rows=GROWTH, target_acos: str | None = None) -> str:
    head = f"{by}, " if by else ""
    values = ", ".join(
        f"('{i}', CAST({g} AS DOUBLE), {', '.join(f'CAST({p} AS DOUBLE)' for p in pins)}, "
        f"{'true' if any(p != 'NULL' for p in pins) else 'false'})"
        for i, g, *pins in rows)
    acos = "spend / nullif(CASE WHEN ad_sales > 0 THEN ad_sales END, 0) * 100"
    worn = target_acos or f"(coalesce(nullif({acos}, 0), 20.0) * (1 + growth_pct / 10 * 0.04))"
    return f"""SELECT {head}scenario_id, growth_pct, is_custom,
 {r("base_rev", 2)} AS baseline_revenue, {r("spend", 2)} AS current_ad_spend, {r("ad_sales", 2)} AS current_ad_sales,
 {r(f"nullif({acos}, 0)", 2)} AS current_acos_pct,
 {r("nullif(CASE WHEN base_rev > 0 THEN spend / base_rev * 100 END, 0)", 2)} AS current_tacos_pct,
 {r("nullif(CASE WHEN spend > 0 THEN ad_sales / spend END, 0)", 2)} AS current_roas,
 {r("greatest(base_rev - ad_sales, 0)", 2)} AS baseline_organic_sales,
 coalesce({pos("ad_sales", "base_rev", 1, True)}, 0) AS baseline_ad_contribution,
 coalesce({pos("greatest(base_rev - ad_sales, 0)", "base_rev", 1, True)}, 0) AS baseline_org_contribution,
 {r("target", 2)} AS target_revenue, {r("target - base_rev", 2)} AS revenue_gap,
 {r("target - base_rev", 2)} AS incremental_revenue, {r("goal", 2)} AS target_ad_sales,
 {r("rec", 2)} AS recommended_spend, {r("rec - spend", 2)} AS incremental_spend,
 coalesce({pos("rec", "goal", 2, True)}, 0) AS projected_acos_pct, {pos("goal", "rec", 2)} AS projected_roas,
 {pos("rec", "target", 2, True)} AS projected_tacos_pct,
 {r("greatest(target - goal, 0)", 2)} AS projected_organic_sales,
 coalesce({pos("goal", "target", 1, True)}, 0) AS projected_ad_contribution,
 coalesce({pos("greatest(target - goal, 0)", "target", 1, True)}, 0) AS projected_org_contribution,
 rec AS spend_exact, rec - spend AS incremental_exact
 FROM (SELECT *, CASE WHEN p_spend > 0 THEN p_spend WHEN p_roas > 0 THEN goal / p_roas
   WHEN p_tacos > 0 THEN target * (p_tacos / 100) ELSE goal * ({worn} / 100) END AS rec
  FROM (SELECT *, CASE WHEN p_sales > 0 THEN p_sales ELSE ad_sales + (target - base_rev) *
    CASE WHEN base_rev > 0 AND ad_sales > 0 THEN least(ad_sales / base_rev, 0.9) ELSE 0.4 END END AS goal
   FROM (SELECT *, CASE WHEN p_rev > 0 AND base_rev > 0 THEN {r("(p_rev / base_rev - 1) * 100", 2)} ELSE asked END AS growth_pct,
     CASE WHEN p_rev > 0 THEN p_rev ELSE base_rev * (1 + asked / 100) END AS target
    FROM (SELECT *, CASE WHEN revenue > 0 THEN revenue ELSE ad_sales END AS base_rev FROM {base_name}),
     (VALUES {values}) AS x(scenario_id, asked, p_rev, p_spend, p_sales, p_roas, p_tacos, is_custom))))"""


PARTS["base_all"] = base()
PARTS["base_brand"] = base("brand")
PARTS["base_asin"] = base("asin")
PARTS["plan_all"] = forecast("base_all")
PARTS["plan_brand"] = forecast("base_brand", "brand")
PARTS["plan_asin"] = forecast("base_asin", "asin")

PARTS["calendar"] = """SELECT *, CAST(mult AS DOUBLE) AS multiplier,
 CAST(mult AS DOUBLE) / CAST(sum(mult) OVER () AS DOUBLE) AS weight,
 round_even((CAST(mult AS DOUBLE) - 1) * 100, 0) AS uplift_pct FROM (VALUES
 (1, 'Jan', '🎉 New Year Deals', true, 1.00), (2, 'Feb', '💝 Valentine''s Day', true, 1.10),
 (3, 'Mar', '🌸 Spring Sale', true, 1.00), (4, 'Apr', '—', false, 1.00),
 (5, 'May', '💐 Mother''s Day', true, 1.08), (6, 'Jun', '👔 Father''s Day · ☀️ Mid-Year Sale', true, 1.08),
 (7, 'Jul', '⚡ Prime Day · 🌞 Summer Sale', true, 1.30), (8, 'Aug', '🎒 Back to School', true, 1.05),
 (9, 'Sep', '—', false, 1.00), (10, 'Oct', '🍂 Pre-Holiday Push · ⚡ Prime Big Deal Days', true, 1.20),
 (11, 'Nov', '🛒 Black Friday · 💻 Cyber Monday', true, 1.45),
 (12, 'Dec', '🎄 Holiday Season · 🎁 Year-End Sale', true, 1.25)) AS c(month, month_name, events, is_event_month, mult)"""


def months(plan: str, actual: str, by: str = "") -> str:
    head = f"p.{by}, " if by else ""
    join = f"AND a.{by} = p.{by}" if by else ""
    projected = lambda act, annual: (
        f"coalesce({r(f'{act} * (1 + growth_pct / 100)', 2)}, "
        f"CASE WHEN {annual} > 0 THEN {r(f'{annual} * weight', 2)} END, 0)")
    set_ = "a_spend <> 0 AND a_sales <> 0"
    return f"""SELECT {by + ', ' if by else ''}scenario_id, month, month_name, a_spend AS actual_spend, a_sales AS actual_ad_sales,
 CASE WHEN {set_} THEN {ratio("a_spend", "a_sales", 2, True)} END AS actual_acos_pct,
 CASE WHEN {set_} THEN {ratio("a_sales", "a_spend", 2)} END AS actual_roas, a_impr AS actual_impressions,
 projected_spend, projected_ad_sales, {pos("projected_spend", "projected_ad_sales", 2, True)} AS projected_acos_pct,
 {pos("projected_ad_sales", "projected_spend", 2)} AS projected_roas, events, is_event_month, uplift_pct,
 {r("projected_spend * 0.65", 2)} AS sp_budget, {r("projected_spend * 0.25", 2)} AS sb_budget,
 {r("projected_spend * 0.1", 2)} AS sd_budget
 FROM (SELECT {head}scenario_id, c.*, a.spend AS a_spend, a.ad_sales AS a_sales, a.impressions AS a_impr,
  {projected("a.spend", "recommended_spend")} AS projected_spend,
  {projected("a.ad_sales", "target_ad_sales")} AS projected_ad_sales
  FROM {plan} p CROSS JOIN calendar c LEFT JOIN {actual} a ON a.month = c.month {join})"""


PARTS["month_all"] = months("plan_all", "actual")
PARTS["month_brand"] = months("plan_brand", "actual_brand", "brand")

# --- parts: budgets -------------------------------------------------------------------------------------------

PARTS["optimised"] = f"""SELECT *, {r("optimised_budget - current_spend", 2)} AS delta FROM (
 SELECT campaign_name AS campaign, {r("spend", 2)} AS current_spend, {r("ad_sales", 2)} AS ad_sales,
  {r("w_roas", 2)} AS roas, {r("w_acos", 2)} AS acos_pct, {r("w_cvr", 2)} AS cvr_pct,
  {r("CASE WHEN whole = 0 THEN 1 ELSE eff END", 3)} AS efficiency,
  {r("CASE WHEN whole = 0 THEN 1.0 / n ELSE eff / whole END * budget", 2)} AS optimised_budget
 FROM (SELECT *, CAST(sum(CAST(eff AS DECIMAL(32,12))) OVER () AS DOUBLE) AS whole, count(*) OVER () AS n,
   {r("CAST(sum(CAST(spend AS DECIMAL(28,6))) OVER () AS DOUBLE)", 2)} AS budget
  FROM (SELECT *, CASE WHEN spend = 0 AND ad_sales = 0 THEN 0 ELSE w_roas * w_cvr / w_acos END AS eff
   FROM (SELECT *, greatest(coalesce(roas, 1), 0.1) AS w_roas, greatest(coalesce(cvr_pct, 5), 0.1) AS w_cvr,
     greatest(coalesce(acos_pct, 30), 1) AS w_acos FROM camp))))"""


def recommended(camps: str, plan: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    join = f"USING ({by})" if by else ""
    cross = "JOIN" if by else "CROSS JOIN"
    return f"""SELECT {head}scenario_id, campaign_name AS campaign, {r("spend", 2)} AS current_spend, suggested_increase,
 {r("spend + suggested_increase", 2)} AS new_budget, {r("roas", 2)} AS roas, {r("acos_pct", 2)} AS acos_pct
 FROM (SELECT c.*, p.scenario_id, {r("roas / whole * incremental_exact", 2)} AS suggested_increase
  FROM (SELECT *, CAST(sum(CAST(roas AS DECIMAL(28,6))) OVER ({over}) AS DOUBLE) AS whole,
    row_number() OVER ({over} ORDER BY spend DESC, campaign_name) AS place FROM {camps} WHERE roas > 0) c
  {cross} {plan} p {join} WHERE place <= 10)"""


PARTS["recs"] = recommended("camp", "plan_all")
PARTS["recs_brand"] = recommended("camp_brand", "plan_brand", "brand")

# --- sources and sinks ------------------------------------------------------------------------------------------

WHOLE = grouped("match_type, campaign_type", [*CORE, "ad_orders_ntb"])
for _name in ("read_report", "parse_ads", "read_report_stream"):
    oracle(_name, WHOLE)
oracle("read_report_encodings", f"""
SELECT match_type, 'Café Größe ' || brand AS portfolio_name, {sums(["spend", "clicks"])} FROM ads GROUP BY ALL""")
oracle("route_reports", f"""
SELECT 'ads' AS kind, match_type AS key, {s("spend")} AS amount, {s("clicks", "report_date >= DATE '1998-01-01'")} AS units, CAST(4 AS BIGINT) AS moved FROM ads GROUP BY match_type
UNION ALL SELECT 'vendor', 'all', {s("ordered_revenue")}, {s("ordered_units")}, CAST(2 AS BIGINT) FROM ven""")
oracle("parse_vendor", vkpi("report_date"))
oracle("classify_reports", """
SELECT file, vendor_hits, ads_hits, CASE WHEN vendor_hits > ads_hits THEN 'vendor' ELSE 'ads' END AS kind FROM (
 SELECT l_orderkey AS file,
  CAST(count(DISTINCT CASE WHEN k IN (1, 3, 5, 8) THEN k END) AS INTEGER) AS vendor_hits,
  CAST(count(DISTINCT CASE WHEN k IN (0, 2, 4, 7, 10) THEN k END) AS INTEGER) AS ads_hits
 FROM (SELECT l_orderkey, l_partkey % 11 AS k FROM lineitem) GROUP BY l_orderkey)""")
oracle("save_and_load_stage", f"""
SELECT CAST(date_trunc('month', report_date) AS DATE) AS month, {sums(["spend", "ad_sales"])}
FROM ads WHERE report_date >= DATE '1997-01-01' GROUP BY ALL""")
_summary = [
    ("Total Ordered Revenue (Vendor)", "total_ordered_revenue"), ("Total Ad Spend", "total_spend"),
    ("Total Ad-Attributed Sales", "total_ad_sales"), ("Overall ACOS (%)", "coalesce(overall_acos, 0) / 100"),
    ("Overall ROAS", "overall_roas"), ("Total Impressions", "total_impressions"), ("Total Clicks", "total_clicks"),
    ("Overall CTR (%)", "coalesce(overall_ctr, 0) / 100"), ("CPC ($)", "overall_cpc"),
    ("Avg Selling Price ($)", "avg_selling_price")]
oracle("plan_executive_summary", union([
    f"SELECT {i} AS line, '{label}' AS label, {x} AS value FROM kpi CROSS JOIN vkpi"
    for i, (label, x) in enumerate(_summary, start=1)]))
_channels = [("sponsored_products", "0.65"), ("sponsored_brands", "0.25"), ("sponsored_display", "0.1")]
_scenario_amounts = ["growth_pct", "baseline_revenue", "target_revenue", "revenue_gap", "current_ad_spend", "recommended_spend",
                     "incremental_spend", "target_ad_sales", "projected_acos_pct", "projected_roas", "projected_tacos_pct",
                     *[f"{c}_{x}" for c, _ in _channels for x in ("budget", "incremental")]]
_scenario_sheet = f"""SELECT scenario_id, {", ".join(_scenario_amounts[:11])},
 {", ".join(f'{r(f"spend_exact * {w}", 2)} AS {c}_budget, {r(f"incremental_exact * {w}", 2)} AS {c}_incremental' for c, w in _channels)}
FROM plan_all"""
oracle("plan_scenarios", _scenario_sheet)
oracle("plan_campaign_recs", "SELECT * FROM recs WHERE scenario_id = '+10%'")
oracle("plan_campaigns", "SELECT * FROM camp")
oracle("plan_asins", "SELECT * FROM merged")
_health_names = {
    "asin": "ASIN", "score": "Health Score (0–100)", "tier": "Tier", "spend": "Ad Spend ($)",
    "ad_sales": "Ad Sales ($)", "roas": "ROAS", "acos_pct": "ACOS (%)", "cvr_pct": "CVR (%)", "ntb_pct": "NTB (%)",
    "impressions": "Impressions", "ordered_revenue": "Ordered Revenue ($)", "ordered_units": "Ordered Units"}
oracle("plan_health", "SELECT " + ", ".join(f'{k} AS "{v}"' for k, v in _health_names.items()) + " FROM health")
_month_names = {
    "scenario_id": "scenario_id", "month": "Month", "month_name": "Month Name", "actual_spend": "Actual Spend ($)",
    "actual_ad_sales": "Actual Ad Sales ($)", "actual_acos_pct": "Actual ACOS (%)", "actual_roas": "Actual ROAS",
    "actual_impressions": "Actual Impressions", "projected_spend": "Projected Spend ($)",
    "projected_ad_sales": "Projected Ad Sales ($)", "projected_acos_pct": "Projected ACOS (%)",
    "projected_roas": "Projected ROAS", "events": "Key Events", "is_event_month": "Event Month?",
    "uplift_pct": "Spend Uplift %", "sp_budget": "SP Budget ($)", "sb_budget": "SB Budget ($)",
    "sd_budget": "SD Budget ($)"}
oracle("plan_monthly", "SELECT " + ", ".join(f'{k} AS "{v}"' for k, v in _month_names.items()) + " FROM month_all")



def written(name: str, source: str, amounts: list[str]) -> str:
    cents = " + ".join(f'coalesce(CAST(round_even("{c}" * 100, 0) AS DECIMAL(38,0)), 0)' for c in amounts)
    return f"""SELECT '{name}' AS "table", count(*) AS rows, CAST(sum({cents}) AS DOUBLE) AS cents FROM ({source})"""


_all_sums, _idle = [*FULL, "sales_ntb"], f""", {s("spend", "coalesce(ad_orders, 0) = 0")} AS idle_spend"""
_ratios4 = ["acos_pct", "roas", "cpc", "cvr_pct"]
oracle("write_media_plan", union([
    written("executive_summary", union([f"SELECT {x} AS value FROM kpi CROSS JOIN vkpi" for _, x in _summary]), ["value"]),
    written("scenarios", _scenario_sheet, _scenario_amounts),
    written("campaign_recommendations", "SELECT * FROM recs WHERE scenario_id = '+10%'", ["current_spend", "suggested_increase", "new_budget", "roas", "acos_pct"]),
    written("campaign_performance", f"SELECT *, {RATIOS} FROM ({grouped('campaign_name', _all_sums, more=_idle)})", [*_all_sums, "idle_spend", *_ratios4]),
    written("asin_analysis", f"""SELECT a.*, v.* EXCLUDE (asin), {ratio("a.spend", "v.ordered_revenue", 2, True)} AS tacos_pct
 FROM (SELECT *, {RATIOS}, {NTB} FROM ({grouped('asin', _all_sums, more=_idle)})) a FULL OUTER JOIN asin_ven v ON a.asin = v.asin""",
            [*_all_sums, "idle_spend", *_ratios4, "ntb_pct", *VENDOR, "avg_price", "tacos_pct"]),
    written("asin_health", "SELECT * FROM health", [c for c in _health_names if c not in ("asin", "tier")]),
    written("monthly_plan", "SELECT * FROM month_all", [c for c in _month_names if c not in ("scenario_id", "month", "month_name", "events", "is_event_month")])]))

# --- projections and cleaning -------------------------------------------------------------------------------------

oracle("normalise_columns", """
SELECT match_type, count(search_term) AS terms, count(asin) AS asins,
 max(CASE WHEN spend = 0 THEN '--' ELSE '$' || format('{:,.4f}', CAST(spend AS DOUBLE)) END) AS spend_text
FROM ads GROUP BY match_type""")
oracle("merge_colliding_columns", f"""
SELECT match_type, {s("CASE WHEN ad_orders > 0 THEN spend ELSE ad_sales END")} AS spend FROM ads GROUP BY match_type""")
oracle("clean_numeric", """
SELECT match_type, count(*) AS rows, count(CASE WHEN spend <> 0 THEN 1 END) AS spends,
 count(CASE WHEN match_type = 'Exact' THEN 1 END) AS cpcs, max(CASE WHEN match_type = 'Exact' THEN 12.5::DOUBLE END) AS top_cpc,
 CAST(max(spend) AS DOUBLE) AS top_spend, CAST(min(impressions) AS DOUBLE) AS low_impressions FROM ads GROUP BY match_type""")
oracle("infer_numeric", """
SELECT l_returnflag AS flag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
 count(CASE WHEN l_tax > 0 THEN 1 END) AS taxed, max(CASE WHEN l_tax > 0 THEN round(l_tax * 100, 1) END) AS top_tax,
 'string' AS lot_type FROM lineitem GROUP BY l_returnflag""")
oracle("normalise_campaign_type", """
SELECT campaign_type, count(*) AS rows FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'Sponsored Brands'
 WHEN 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High'
  WHEN '3-MEDIUM' THEN '3-Medium' WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' WHEN '5-LOW' THEN '5-Low' END
 ELSE 'Sponsored Tv-Ads' END AS campaign_type FROM orders) GROUP BY campaign_type""")
oracle("vendor_period_to_date", grouped("report_date", ["ordered_revenue"], "ven"))
oracle("validate_reports", """
SELECT 'ads' AS kind, count(*) AS row_count, '' AS missing, true AS is_valid FROM ads
UNION ALL SELECT 'ads', count(*), 'spend,ad_sales', false FROM ads
UNION ALL SELECT 'vendor', count(*), '', true FROM ven
UNION ALL SELECT 'vendor', count(*), 'ordered_revenue', false FROM ven""")
for _name in ("parse_date_range", "parse_date_range_day_first"):
    oracle(_name, """
SELECT l_linenumber, CASE WHEN l_linenumber IN (1, 2, 3, 5, 6) OR l_linenumber = 7 AND l_orderkey % 2 = 0 THEN CAST(l_shipdate AS DATE) END AS start,
 count(*) AS rows FROM lineitem GROUP BY ALL""")
oracle("resolve_date", """
SELECT CASE WHEN l_linenumber < 6 THEN CAST(l_shipdate AS DATE) END AS date, count(*) AS rows FROM lineitem GROUP BY ALL""")
oracle("date_summary", union([
    f"""SELECT '{c}' AS "column", count(*) FILTER ({filled}) AS filled, count(*) FILTER ({dated}) AS dated,
 count(*) FILTER (({filled}) AND NOT ({dated})) AS undated, {first} AS day_first, {chosen} AS chosen FROM lineitem"""
    for c, filled, dated, first, chosen in (("start_date", "true", "false", "false", "false"),
                                            ("report_date", "l_linenumber < 7", "l_linenumber < 6", "true", "true"),
                                            ("week_date", "true", "true", "false", "false"))]))
oracle("period_start", """
SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
 count(*) AS rows FROM orders GROUP BY ALL""")
oracle("add_ratios", f"SELECT *, {RATIOS} FROM ({grouped('match_type, campaign_name', CORE)})")
oracle("add_ntb_pct", f"SELECT *, {NTB} FROM ({grouped('brand', ['ad_orders', 'ad_orders_ntb'])})")
oracle("metric_bands", """
SELECT asin, acos_pct, roas,
 CASE WHEN acos_pct = 0 THEN NULL WHEN acos_pct <= 20 THEN 'Efficient' WHEN acos_pct <= 35 THEN 'Acceptable'
  WHEN acos_pct > 35 THEN 'High' END AS acos_band,
 CASE WHEN acos_pct < 20 THEN 'green' WHEN acos_pct < 35 THEN 'amber' WHEN acos_pct >= 35 THEN 'red' END AS acos_colour,
 CASE WHEN roas = 0 THEN NULL WHEN roas >= 4 THEN 'Strong' WHEN roas >= 2 THEN 'Adequate' WHEN roas < 2 THEN 'Low' END AS roas_band
FROM asin_ads""")
oracle("delta", """
SELECT campaign_name, CASE WHEN pm THEN pct END AS change,
 CASE WHEN pm THEN CASE WHEN diff > 0 THEN 'up' ELSE 'down' END ELSE 'flat' END AS direction,
 CASE WHEN pm THEN diff <= 0 END AS is_good, CASE WHEN qm THEN diff END AS points, CASE WHEN qm THEN diff > 0 END AS points_good
FROM (SELECT *, old IS NOT NULL AND abs(pct) >= 0.01 AS pm, old IS NOT NULL AND abs(diff) >= 0.001 AS qm
 FROM (SELECT *, coalesce((coalesce(new, 0) - old) / nullif(abs(old), 0) * 100, 0) AS pct, coalesce(new, 0) - old AS diff
  FROM (SELECT campaign_name, CAST(sum(CASE WHEN year(report_date) = 1997 THEN spend END) AS DOUBLE) AS new,
    CAST(sum(CASE WHEN year(report_date) = 1996 THEN spend END) AS DOUBLE) AS old FROM ads GROUP BY campaign_name)))""")

# --- filters -----------------------------------------------------------------------------------------------------------

oracle("wasted_rows", grouped("match_type", ["spend", "clicks"], where="coalesce(ad_orders, 0) = 0"))
oracle("converting_terms", "SELECT * FROM terms WHERE ad_sales > 0")
oracle("idle_terms", "SELECT * FROM terms WHERE ad_orders = 0 AND spend > 0")
oracle("ntb_terms", "SELECT * FROM terms WHERE ntb_pct IS NOT NULL AND ad_orders >= 2")
oracle("harvest_terms", "SELECT * FROM terms WHERE cvr_pct >= 5 AND spend > 0")
oracle("filter_tiers", "SELECT asin, score, tier FROM scored WHERE tier IN ('Scale', 'Review')")
oracle("budget_gainers", "SELECT campaign, delta FROM optimised WHERE delta > 0")
oracle("budget_losers", "SELECT campaign, delta FROM optimised WHERE delta < 0")
oracle("campaign_outliers", f"""
SELECT * FROM (SELECT asin, campaign_name, spend, acos_pct, roas,
 coalesce(acos_pct > 80 AND spend > 100, false) AS high_acos, coalesce(roas, 0) = 0 AND spend > 50 AS zero_roas
 FROM (SELECT *, {RATIOS} FROM ({grouped('asin, campaign_name', CORE)}))) WHERE high_acos OR zero_roas""")
oracle("dated_rows", f"""
SELECT CAST(l_shipdate AS DATE) AS date, {s(dec("l_quantity"))} AS clicks FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL""")

# --- joins -----------------------------------------------------------------------------------------------------------------

oracle("merge_asin_view", "SELECT * FROM merged")
oracle("metadata_attach", """
SELECT a.asin, a.spend, m.product_title, m.category, m.brand FROM asin_ads a
JOIN (SELECT asin, min(product_title) AS product_title, min(category) AS category, min(brand) AS brand
 FROM ads GROUP BY asin) m ON a.asin = m.asin""")
oracle("health_with_vendor", """
SELECT p.asin, p.spend, v.ordered_revenue, v.shipped_revenue, v.ordered_units
FROM prod p LEFT JOIN asin_ven v ON p.asin = v.asin""")
oracle("brand_totals", f"""
SELECT *, spend / brand_spend AS share FROM ({grouped('brand, campaign_name', ['spend'])})
JOIN (SELECT brand, {s("spend")} AS brand_spend FROM ads GROUP BY brand) USING (brand)""")
SCENARIO_COLUMNS = ("scenario_id, growth_pct, target_revenue, revenue_gap, recommended_spend, incremental_spend, "
                    "projected_acos_pct, projected_roas, projected_tacos_pct")
oracle("entity_scenarios", f"SELECT brand, {SCENARIO_COLUMNS} FROM plan_brand")
oracle("entity_months", """
SELECT brand, scenario_id, month, actual_spend, projected_spend, projected_ad_sales, sd_budget FROM month_brand""")
_limits = [("ACOS", "overall_acos", ">", 35.0, "critical"), ("ACOS", "overall_acos", "<", 5.0, "warning"),
           ("ROAS", "overall_roas", "<", 2.0, "critical"), ("ROAS", "overall_roas", ">", 20.0, "warning"),
           ("CTR", "overall_ctr", "<", 0.1, "critical"), ("CVR", "conversion_rate", "<", 1.0, "critical"),
           ("CPC", "overall_cpc", ">", 5.0, "warning")]


def hits(source: str, by: str) -> str:
    return union([
        f"SELECT {by}, '{m}' AS metric, '{sev}' AS severity, {c} AS value, CAST({lim} AS DOUBLE) AS \"limit\" "
        f"FROM {source} WHERE {c} <> 0 AND {c} {op} {lim}" for m, c, op, lim, sev in _limits])


oracle("threshold_hits", hits("kpi_asin", "asin"))
_own = {("ACOS", ">"): "CASE brand WHEN 'Brand#11' THEN 10.0 WHEN 'Brand#23' THEN NULL ELSE 35.0 END"}
oracle("limit_hits", union([
    f"SELECT brand, '{m}' AS metric, '{sev}' AS severity, {c} AS value, CAST({_own.get((m, op), lim)} AS DOUBLE) AS \"limit\" "
    f"FROM kpi_brand WHERE {c} <> 0 AND {c} {op} {_own.get((m, op), lim)}"
    for m, c, op, lim, sev in [*_limits, ("CPC", "overall_cpc", "<", "CASE brand WHEN 'Brand#11' THEN 1000.0 END", "note")]]))

# --- aggregations --------------------------------------------------------------------------------------------------------------

oracle("ads_kpis", "SELECT * FROM kpi")
oracle("ads_kpis_by_brand", "SELECT * FROM kpi_brand")
oracle("vendor_kpis", "SELECT * FROM vkpi")
oracle("vendor_kpis_with_price", f"""
SELECT brand, {", ".join(f"{s(k)} AS {v}" for k, v in VKPI_SUMS.items())},
 {r("CAST(sum(list_price) AS DOUBLE) / count(list_price)", 2)} AS avg_selling_price FROM ven GROUP BY brand""")
oracle("breakdown", grouped("brand", CORE))
oracle("campaign_breakdown", "SELECT * FROM camp")
oracle("asin_ads_breakdown", "SELECT * FROM asin_ads")
oracle("asin_vendor_breakdown", "SELECT * FROM asin_ven")
oracle("match_type_breakdown", f"SELECT *, {RATIOS} FROM ({grouped('match_type', CORE)})")
oracle("bid_strategy_breakdown", f"SELECT *, {RATIOS} FROM ({grouped('bid_strategy', CORE)})")
oracle("category_breakdown", f"SELECT *, {RATIOS} FROM ({grouped('category', CORE)})")
_share = "CAST(sum(CAST(spend AS DECIMAL(18,4))) OVER ({}) AS DOUBLE)"
oracle("ad_product_breakdown", f"""
SELECT *, {RATIOS}, {ratio("spend", _share.format(""), 1, True)} AS spend_share_pct
FROM (SELECT campaign_type AS ad_product, * EXCLUDE (campaign_type) FROM ({grouped('campaign_type', CORE)}))""")
oracle("ad_product_breakdown_by_brand", f"""
SELECT *, {RATIOS}, {ratio("spend", _share.format("PARTITION BY brand"), 1, True)} AS spend_share_pct
FROM (SELECT brand, campaign_type AS ad_product, * EXCLUDE (brand, campaign_type)
 FROM ({grouped('brand, campaign_type', CORE)}))""")
oracle("search_term_breakdown", "SELECT * FROM terms")
oracle("product_breakdown", "SELECT * FROM prod")
_bulk = [("campaign", "campaign_name"), ("asin", "asin"), ("match_type", "match_type"),
         ("bid_strategy", "bid_strategy"), ("ad_product", "campaign_type")]
oracle("all_breakdowns", f"SELECT *, {RATIOS} FROM (" + union([
    f"SELECT '{n}' AS dimension, {c} AS key, {sums(FULL)} FROM ads WHERE {c} IS NOT NULL GROUP BY {c}"
    for n, c in _bulk]) + ")")
oracle("wasted_spend_summary", f"""
SELECT campaign_type, {r("wasted", 2)} AS wasted_spend, coalesce({pos("wasted", "spent", 1, True)}, 0) AS wasted_pct,
 {r("spent", 2)} AS total_spend
FROM (SELECT campaign_type, {s("spend", "coalesce(ad_orders, 0) = 0")} AS wasted, {s("spend")} AS spent
 FROM ads GROUP BY campaign_type)""")
oracle("impression_quartiles", """
SELECT quantile_cont(impressions, 0.25) AS q1, quantile_cont(impressions, 0.75) AS q3 FROM prod""")
oracle("impression_quartiles_by_category", f"""
SELECT category, quantile_cont(impressions, 0.25) AS q1, quantile_cont(impressions, 0.75) AS q3
FROM ({grouped('category, asin', ['impressions'])}) GROUP BY category""")
oracle("tier_distribution", """
SELECT tier, count(s.asin) AS products,
 CAST(coalesce(round_even(CAST(count(s.asin) AS DOUBLE) / nullif((SELECT count(*) FROM scored), 0) * 100, 0), 0) AS INTEGER) AS pct
FROM (VALUES ('Scale'), ('Optimise'), ('Review'), ('Pause')) AS t(tier) LEFT JOIN scored s USING (tier) GROUP BY tier""")
oracle("score_histogram", """
SELECT bin, count(*) AS products, CAST((bin - 1) * 5 AS DOUBLE) AS bin_start
FROM (SELECT CAST(least(floor(score / 5) + 1, 20) AS BIGINT) AS bin FROM scored) GROUP BY bin""")


def histogram(source: str, value: str, bins: int, by: str = "") -> str:
    head, using = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    tail = f" GROUP BY {by}" if by else ""
    return f"""SELECT {head}floor({value} / width) * width AS bin_start, width, count(*) AS rows FROM {source} JOIN (
 SELECT {head}min(w) AS width FROM (SELECT {head}min({value}) AS lo, max({value}) AS hi FROM {source}{tail}),
  (SELECT CAST(m || 'e' || e AS DOUBLE) AS w FROM (VALUES (1), (2), (5)) AS a(m), range(-6, 16) AS b(e))
 WHERE floor(hi / w) - floor(lo / w) + 1 <= {bins} AND w >= power(10, floor(log10(CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE greatest(abs(hi) / 10, 1) END)))
 {tail}) {using} GROUP BY ALL"""


oracle("spend_histogram", histogram("camp", "spend", 20))
oracle("spend_histogram_by_brand", histogram("camp_brand", "spend", 12, "brand"))


def concentration(source: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""SELECT {head}top_spend, total_spend, {ratio("top_spend", "total_spend", 6)} AS top_share,
 coalesce(total_spend > 0 AND top_spend / total_spend > 0.7, false) AS is_risk
 FROM (SELECT {head}CAST(sum(CAST(CASE WHEN place <= 5 THEN spend END AS DECIMAL(28,6))) AS DOUBLE) AS top_spend,
  CAST(sum(CAST(spend AS DECIMAL(28,6))) AS DOUBLE) AS total_spend
  FROM (SELECT *, row_number() OVER ({over} ORDER BY spend DESC, campaign_name) AS place FROM {source}){tail})"""


PARTS["concentrated_brand"] = concentration("camp_brand", "brand")
PARTS["concentrated"] = concentration("camp")
oracle("spend_concentration", "SELECT * FROM concentrated")
oracle("spend_concentration_by_brand", "SELECT * FROM concentrated_brand")
oracle("reallocation_summary", """
SELECT count(CASE WHEN delta > 0 THEN 1 END) AS gainers,
 CAST(coalesce(sum(CAST(CASE WHEN delta > 0 THEN delta END AS DECIMAL(28,4))), 0) AS DOUBLE) AS gained,
 count(CASE WHEN delta < 0 THEN 1 END) AS losers,
 abs(CAST(coalesce(sum(CAST(CASE WHEN delta < 0 THEN delta END AS DECIMAL(28,4))), 0) AS DOUBLE)) AS lost,
 count(CASE WHEN delta = 0 THEN 1 END) AS unchanged FROM optimised""")
oracle("first_attribute", "SELECT brand, min(product_title) AS product_title, min(category) AS category FROM ven GROUP BY brand")

# --- time series -----------------------------------------------------------------------------------------------------------------

oracle("trend_weekly", trend("week"))
oracle("trend_monthly", "SELECT * FROM monthly")


def changes(source: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""

    def change(c: str, name: str) -> str:
        return f"{r(f'({c} - lag({c}) OVER w) / nullif(abs(lag({c}) OVER w), 0) * 100', 1)} AS {name}"

    return f"""SELECT {head}{change("spend", "spend_change_pct")}, {change("ad_sales", "sales_change_pct")},
 {change("acos_pct", "acos_change_pct")}, {change("roas", "roas_change_pct")}, period_start AS latest_period,
 lag(period_start) OVER w AS prev_period FROM {source} WINDOW w AS ({over}ORDER BY period_start)
 QUALIFY lag(period_start) OVER w IS NOT NULL AND period_start = max(period_start) OVER ({over})"""


oracle("trend_summary", changes("monthly"))
oracle("trend_summary_by_brand", changes("monthly_brand", "brand"))
oracle("ad_product_trend", f"""
SELECT CAST(date_trunc('month', report_date) AS DATE) AS period_start, campaign_type, {s("spend")} AS spend FROM ads GROUP BY ALL""")
oracle("peak_period", """
SELECT * FROM monthly_brand QUALIFY row_number() OVER (PARTITION BY brand ORDER BY ad_sales DESC, period_start) = 1""")
oracle("monthly_actuals", "SELECT * FROM actual")
oracle("monthly_actuals_by_product", "SELECT * FROM actual_asin")

# --- sorts and heads -----------------------------------------------------------------------------------------------------------------

oracle("top_converting", "SELECT * FROM terms WHERE ad_sales > 0 ORDER BY ad_sales DESC, search_term LIMIT 20")
oracle("wasted_terms", "SELECT * FROM terms WHERE ad_orders = 0 AND spend > 0 ORDER BY spend DESC, search_term LIMIT 20")
oracle("ntb_leaders", """
SELECT * FROM terms WHERE ntb_pct IS NOT NULL AND ad_orders >= 2 ORDER BY ntb_pct DESC, search_term LIMIT 20""")
oracle("harvest_candidates", """
SELECT * FROM terms WHERE cvr_pct >= 5 AND spend > 0 ORDER BY cvr_pct DESC, search_term LIMIT 15""")
oracle("top_roas", "SELECT asin, roas, ad_sales FROM prod WHERE roas IS NOT NULL ORDER BY roas DESC, asin LIMIT 10")
oracle("worst_acos", """
SELECT asin, acos_pct, spend FROM prod WHERE acos_pct IS NOT NULL ORDER BY acos_pct DESC, asin LIMIT 10""")
oracle("top_n_by_brand", f"""
SELECT * FROM ({grouped('brand, asin', ['spend'])})
QUALIFY row_number() OVER (PARTITION BY brand ORDER BY spend DESC, asin) <= 5""")
oracle("top_n_with_other", f"""
WITH positive AS (SELECT campaign, optimised_budget, row_number() OVER (ORDER BY efficiency DESC, campaign) AS place
 FROM optimised WHERE optimised_budget > 0)
SELECT campaign, optimised_budget FROM positive WHERE place <= 12
UNION ALL SELECT * FROM (SELECT 'Other' AS campaign,
 {r("CAST(sum(CAST(optimised_budget AS DECIMAL(18,4))) FILTER (place > 12) AS DOUBLE)", 2)} AS optimised_budget FROM positive)
WHERE optimised_budget > 0""".replace("WITH positive AS (", "SELECT * FROM (WITH positive AS (") + ")")

# --- set operations --------------------------------------------------------------------------------------------------------------------

oracle("stack_reports", f"""
SELECT match_type, {s("spend")} AS spend, {s("ad_sales", "report_date < DATE '1998-01-01'")} AS ad_sales,
 {s("clicks", "report_date >= DATE '1998-01-01'")} AS clicks FROM ads GROUP BY match_type""")
oracle("what_if_table", f"""
SELECT 'current' AS scenario, rev AS target_revenue, 0.0::DOUBLE AS revenue_gap, 0.0::DOUBLE AS incremental_revenue,
 spend AS recommended_spend, 0.0::DOUBLE AS incremental_spend, ad_sales AS target_ad_sales,
 coalesce({pos("ad_sales", "rev", 1, True)}, 0) AS ad_contribution, greatest(rev - ad_sales, 0) AS organic_sales,
 coalesce({pos("greatest(rev - ad_sales, 0)", "rev", 1, True)}, 0) AS org_contribution,
 coalesce({pos("spend", "ad_sales", 2, True)}, 0) AS acos_pct, coalesce({both("ad_sales", "spend", 2)}, 0) AS roas,
 coalesce({pos("spend", "rev", 2, True)}, 0) AS tacos_pct
FROM (SELECT *, CASE WHEN revenue > 0 THEN revenue ELSE ad_sales END AS rev FROM base_all)
UNION ALL SELECT scenario_id, target_revenue, revenue_gap, incremental_revenue, recommended_spend, incremental_spend,
 target_ad_sales, projected_ad_contribution, projected_organic_sales, projected_org_contribution, projected_acos_pct,
 coalesce(projected_roas, 0), coalesce(projected_tacos_pct, 0) FROM plan_all""")
oracle("distinct_keys", "SELECT DISTINCT campaign_name FROM ads")

# --- scoring ---------------------------------------------------------------------------------------------------------------------------------

oracle("asin_health", "SELECT asin, score, tier, spend, ordered_revenue, ordered_units FROM health")
oracle("tier", """
SELECT CASE WHEN p_size * 2 >= 80 THEN 'Scale' WHEN p_size * 2 >= 55 THEN 'Optimise' WHEN p_size * 2 >= 35 THEN 'Review'
 ELSE 'Pause' END AS tier, count(*) AS rows FROM part GROUP BY ALL""")
oracle("account_health", """
SELECT asin, health_score, CASE WHEN health_score >= 80 THEN 'Excellent' WHEN health_score >= 60 THEN 'Good'
 WHEN health_score >= 40 THEN 'Fair' ELSE 'Needs Work' END AS grade, acos_status, roas_status, ctr_status, cvr_status
FROM (SELECT asin, CAST(CASE WHEN overall_acos <= 20 THEN 25 WHEN overall_acos <= 35 THEN 15 ELSE 0 END
  + CASE WHEN overall_roas >= 4 THEN 25 WHEN overall_roas >= 2 THEN 15 ELSE 0 END
  + CASE WHEN overall_ctr >= 0.5 THEN 25 WHEN overall_ctr >= 0.3 THEN 15 ELSE 0 END
  + CASE WHEN conversion_rate >= 10 THEN 25 WHEN conversion_rate >= 5 THEN 15 ELSE 0 END AS DOUBLE) AS health_score,
 CASE WHEN overall_acos <= 20 THEN 'Excellent' WHEN overall_acos <= 35 THEN 'Acceptable' WHEN overall_acos > 35 THEN 'High' END AS acos_status,
 CASE WHEN overall_roas >= 4 THEN 'Strong' WHEN overall_roas >= 2 THEN 'Adequate' WHEN overall_roas < 2 THEN 'Low' END AS roas_status,
 CASE WHEN overall_ctr >= 0.5 THEN 'Strong' WHEN overall_ctr >= 0.3 THEN 'Average' WHEN overall_ctr < 0.3 THEN 'Low' END AS ctr_status,
 CASE WHEN conversion_rate >= 10 THEN 'Excellent' WHEN conversion_rate >= 5 THEN 'Average' WHEN conversion_rate < 5 THEN 'Low' END AS cvr_status
 FROM kpi_asin) WHERE coalesce(acos_status, roas_status, ctr_status, cvr_status) IS NOT NULL""")


def clamp(x: str, high: str, invert: bool) -> str:
    c = f"greatest(0::DOUBLE, least(100::DOUBLE, ({x})::DOUBLE / {high}::DOUBLE * 100))"
    return f"(100 - {c})" if invert else c


oracle("benchmark_scores", union([
    f"SELECT asin, '{m}' AS metric, {clamp(x, top, inv)} AS score, {clamp(b, top, inv)} AS benchmark_score FROM kpi_asin"
    for m, x, b, top, inv in [
        ("ACOS efficiency", "coalesce(overall_acos, 0)", "25", "60", True), ("ROAS", "coalesce(overall_roas, 0)", "4", "8", False),
        ("CTR", "coalesce(overall_ctr, 0)", "0.5", "1", False), ("CVR", "coalesce(conversion_rate, 0)", "7", "20", False),
        ("CPC efficiency", "greatest(0, 6 - coalesce(overall_cpc, 0))", "3", "6", False)]]))
oracle("kpi_scorecard", union([
    f"SELECT brand, '{m}' AS metric, {r(c, 2)} AS value, {b}::DOUBLE AS benchmark, {r(f'{c} - {b}::DOUBLE', 2)} AS difference, "
    f"{c} {op} {b} AS on_target FROM kpi_brand WHERE {c} IS NOT NULL"
    for m, c, b, op in [
        ("ACOS (%)", "overall_acos", 25.0, "<="), ("ROAS", "overall_roas", 4.0, ">="), ("CTR (%)", "overall_ctr", 0.35, ">="),
        ("CVR (%)", "conversion_rate", 7.0, ">="), ("CPC ($)", "overall_cpc", 3.0, "<=")]]))
oracle("baseline_check", f"""
SELECT asin, acos_check, roas_check, abs(coalesce(acos_check, 0) - coalesce(overall_acos, 0)) < 0.01 AS acos_ok,
 abs(coalesce(roas_check, 0) - coalesce(overall_roas, 0)) < 0.01 AS roas_ok
FROM (SELECT *, {pos("total_spend", "total_ad_sales", 2, True)} AS acos_check,
 {pos("total_ad_sales", "total_spend", 2)} AS roas_check FROM kpi_asin)""")

# --- planning -----------------------------------------------------------------------------------------------------------------------------------

_default = dict(zip(PRODUCTS3, ("0.65", "0.25", "0.1")))
oracle("normalise_split", f"""
SELECT a.asin, c.channel, coalesce(coalesce(w.weight, 0) / nullif(a.whole, 0), c.fallback) AS weight
FROM (SELECT asin, {s("ad_sales")} AS whole FROM ads GROUP BY asin) a
CROSS JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _default.items())}) AS c(channel, fallback)
LEFT JOIN (SELECT asin, campaign_type, {s("ad_sales")} AS weight FROM ads GROUP BY ALL) w
 ON w.asin = a.asin AND w.campaign_type = c.channel""")
_inner = "EXCLUDE (spend_exact, incremental_exact)"
oracle("forecast", f"SELECT * {_inner} FROM plan_all")
oracle("forecast_by_product", f"SELECT * {_inner} FROM plan_asin")
oracle("forecast_custom", f"SELECT * {_inner} FROM ({forecast('base_all', rows=PINS)})")
oracle("forecast_target_acos", f"""
SELECT brand, scenario_id, recommended_spend, projected_acos_pct
FROM ({forecast("base_brand", "brand", target_acos="25.0::DOUBLE")})""")
oracle("multi_scenario", f"""
SELECT {SCENARIO_COLUMNS} FROM ({forecast("base_all", rows=[(f"+{g}%", g, *["NULL"] * 5) for g in (5, 15, 25, 40, 50)])})""")
oracle("channel_allocation", union([
    f"SELECT brand, scenario_id, '{c}' AS channel, {r(f'spend_exact * {w}::DOUBLE', 2)} AS budget, "
    f"{r(f'incremental_exact * {w}::DOUBLE', 2)} AS incremental_budget, {r(f'{w}::DOUBLE * 100', 1)} AS share_pct FROM plan_brand"
    for c, w in _default.items()]))
oracle("scenario_table", f"SELECT {SCENARIO_COLUMNS} FROM plan_all")
oracle("recommend_campaigns", "SELECT * FROM recs")
oracle("recommend_campaigns_by_brand", "SELECT * FROM recs_brand")
oracle("project_secondary", f"""
SELECT asin, scenario_id, round_even(total_clicks * g, 0) AS clicks, round_even(total_impressions * g, 0) AS impressions,
 orders, coalesce(overall_cpc, 0) AS cpc, coalesce(overall_ctr, 0) AS ctr_pct, coalesce(conversion_rate, 0) AS cvr_pct,
 coalesce({pos("recommended_spend", "orders", 2)}, cost_per_order, 0) AS cost_per_order
FROM (SELECT *, round_even(total_ad_orders * g, 0) AS orders FROM (
 SELECT *, CASE WHEN total_spend > 0 THEN recommended_spend / total_spend ELSE 1 END AS g
 FROM plan_asin JOIN kpi_asin USING (asin)))""")
oracle("monthly_plan", "SELECT * FROM month_all")
_dollars = ["actual_spend", "actual_ad_sales", "projected_spend", "projected_ad_sales", "sp_budget", "sb_budget", "sd_budget"]
oracle("plan_totals", f"""
SELECT * FROM month_all UNION ALL BY NAME
SELECT scenario_id, NULL::INTEGER AS month, 'TOTAL' AS month_name, '—' AS events, NULL::BOOLEAN AS is_event_month,
 NULL::DOUBLE AS uplift_pct, NULL::DOUBLE AS actual_impressions, {", ".join(_dollars)},
 {pos("actual_spend", "actual_ad_sales", 2, True)} AS actual_acos_pct, {pos("actual_ad_sales", "actual_spend", 2)} AS actual_roas,
 {pos("projected_spend", "projected_ad_sales", 2, True)} AS projected_acos_pct,
 {pos("projected_ad_sales", "projected_spend", 2)} AS projected_roas
FROM (SELECT scenario_id, {", ".join(f"CAST(coalesce(sum(CAST({c} AS DECIMAL(28,6))), 0) AS DOUBLE) AS {c}" for c in _dollars)}
 FROM month_all GROUP BY scenario_id)""")
oracle("optimise_budget", "SELECT * FROM optimised")
oracle("scenario_asin_plan", f"""
SELECT scenario_id, tier, asin, score, {r("score / whole * incremental_spend", 2)} AS incremental_budget
FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, asin) AS place FROM (
 SELECT *, sum(score) OVER () AS whole FROM scored)) CROSS JOIN plan_all WHERE tier IN ('Scale', 'Pause') AND place <= 10""")
oracle("seasonal_calendar", """
SELECT month, spend, month_name, events, is_event_month, multiplier, weight, uplift_pct FROM actual JOIN calendar USING (month)""")

# --- rules ------------------------------------------------------------------------------------------------------------------------------------------


def facts(by: str) -> str:
    """One row per entity with all that the rules look at."""
    tiers = f"""SELECT {by}, count(*) AS products, count(CASE WHEN tier = 'Scale' THEN 1 END) AS scale_products,
 CAST(coalesce(sum(CAST(CASE WHEN tier = 'Scale' THEN spend END AS DECIMAL(28,6))), 0) AS DOUBLE) AS scale_spend,
 count(CASE WHEN tier = 'Pause' THEN 1 END) AS pause_products,
 CAST(coalesce(sum(CAST(CASE WHEN tier = 'Pause' THEN spend END AS DECIMAL(28,6))), 0) AS DOUBLE) AS pause_spend
 FROM scored_{by} GROUP BY {by}"""
    camps = f"""SELECT {by}, count(CASE WHEN acos_pct > 80 AND spend > 100 THEN 1 END) AS high_acos,
 count(CASE WHEN coalesce(roas, 0) = 0 AND spend > 50 THEN 1 END) AS zero_roas FROM camp_{by} GROUP BY {by}"""
    waste = f"SELECT {by}, {r(s('spend', 'coalesce(ad_orders, 0) = 0'), 2)} AS wasted_spend FROM ads GROUP BY {by}"
    return f"""SELECT *, {pos("total_spend", "rev", 2, True)} AS tacos FROM (
 SELECT k.*, t.* EXCLUDE ({by}), c.* EXCLUDE ({by}), w.wasted_spend, n.top_share, n.is_risk, p.revenue_gap,
  coalesce(nullif(v.total_ordered_revenue, 0), k.total_ad_sales, 0) AS rev
 FROM kpi_{by} k LEFT JOIN vkpi_{by} v USING ({by}) LEFT JOIN ({tiers}) t USING ({by}) LEFT JOIN ({camps}) c USING ({by})
 LEFT JOIN ({waste}) w USING ({by}) LEFT JOIN concentrated_{by} n USING ({by})
 LEFT JOIN (SELECT {by}, revenue_gap FROM plan_{by} WHERE scenario_id = '+10%') p USING ({by}))"""


PARTS["facts_brand"] = facts("brand")
PARTS["found_anomalies"] = hits("facts_brand", "brand") + """
UNION ALL SELECT brand, 'Campaign ACOS', 'critical', CAST(high_acos AS DOUBLE), 80.0::DOUBLE FROM facts_brand WHERE high_acos > 0
UNION ALL SELECT brand, 'Zero ROAS Campaigns', 'critical', CAST(zero_roas AS DOUBLE), 0.0::DOUBLE FROM facts_brand WHERE zero_roas > 0"""
oracle("anomalies", """
SELECT * FROM found_anomalies UNION ALL SELECT brand, 'All Clear', 'ok', NULL, NULL FROM facts_brand
WHERE brand NOT IN (SELECT brand FROM found_anomalies)""")
_actions = [
    ("reduce_acos", "overall_acos > 35", 1, "High", "Quick Win", "Efficiency", "overall_acos"),
    ("lift_roas", "overall_roas <> 0 AND overall_roas < 2", 1, "High", "Quick Win", "Efficiency", "overall_roas"),
    ("fix_ctr", "overall_ctr <> 0 AND overall_ctr < 0.2", 2, "High", "1–2 weeks", "Creative", "overall_ctr"),
    ("lift_ctr", "overall_ctr >= 0.2 AND overall_ctr < 0.35", 4, "Medium", "1–2 weeks", "Creative", "overall_ctr"),
    ("fix_cvr", "conversion_rate <> 0 AND conversion_rate < 3", 2, "High", "1+ month", "Listing", "conversion_rate"),
    ("cut_cpc", "overall_cpc > 5", 2, "High", "Quick Win", "Bidding", "overall_cpc"),
    ("watch_cpc", "overall_cpc > 3 AND overall_cpc <= 5", 5, "Medium", "Quick Win", "Bidding", "overall_cpc"),
    ("reduce_tacos", "tacos > 18", 3, "High", "1+ month", "Strategy", "tacos"),
    ("scale_budget", "overall_acos <> 0 AND overall_acos <= 20 AND total_spend > 0", 3, "High", "Quick Win", "Scale", "overall_acos"),
    ("grow_ntb", "ntb_order_pct <> 0 AND ntb_order_pct < 20", 6, "Medium", "1–2 weeks", "Acquisition", "ntb_order_pct"),
    ("keep_ntb", "ntb_order_pct >= 40", 7, "Medium", "1–2 weeks", "Retention", "ntb_order_pct"),
    ("pause_products", "pause_products > 0 AND pause_spend > 500", 2, "High", "Quick Win", "Portfolio", "pause_spend"),
    ("spread_budget", "is_risk", 5, "Medium", "1–2 weeks", "Risk", "top_share"),
    ("harvest_terms", "true", 8, "High", "Quick Win", "Optimisation", "NULL::DOUBLE"),
    ("preload_events", "true", 9, "High", "1–2 weeks", "Seasonal", "NULL::DOUBLE"),
]
oracle("actions", """
SELECT brand, CAST(place AS INTEGER) AS place, priority, rule, impact, effort, category, value FROM (
 SELECT *, row_number() OVER (PARTITION BY brand ORDER BY priority, ordinal) AS place FROM (""" + union([
    f"SELECT brand, {i} AS ordinal, {p} AS priority, '{rule}' AS rule, '{imp}' AS impact, '{eff}' AS effort, "
    f"'{cat}' AS category, {v} AS value FROM facts_brand WHERE {cond}"
    for i, (rule, cond, p, imp, eff, cat, v) in enumerate(_actions)]) + ")) WHERE place <= 10")
_roas = "coalesce(overall_roas, 0)"
_scale = f"(scale_spend * 0.25::DOUBLE * CASE WHEN {_roas} > 0 THEN {_roas} ELSE 3 END)"
PARTS["found_opportunities"] = union([
    f"SELECT brand, '{rule}' AS rule, '{kind}' AS type, round_even({x}, 0) AS amount, {m} AS measured FROM facts_brand WHERE {cond}"
    for rule, kind, x, m, cond in [
        ("recover_waste", "Save", "total_spend * 0.12::DOUBLE", "wasted_spend", "total_spend * 0.12::DOUBLE > 500"),
        ("scale_winners", "Grow", _scale, "NULL::DOUBLE", "scale_products > 0 AND scale_spend * 0.25 > 200"),
        ("reallocate_pause", "Optimise", f"pause_spend * {_roas} - pause_spend", "NULL::DOUBLE", f"pause_spend > 500 AND {_roas} > 0"),
        ("growth_gap", "Grow", "revenue_gap", "NULL::DOUBLE", "revenue_gap > 0"),
        ("brand_video", "Grow", "total_spend * 0.25::DOUBLE * 0.3::DOUBLE", "NULL::DOUBLE",
         "overall_ctr <> 0 AND overall_ctr < 0.35 AND total_spend * 0.25::DOUBLE * 0.3::DOUBLE > 1000")]])
oracle("opportunities", "SELECT * FROM found_opportunities")
oracle("opportunity_totals", """
SELECT brand, CAST(coalesce(sum(CASE WHEN type = 'Grow' THEN amount END), 0) AS DOUBLE) AS grow_total,
 CAST(coalesce(sum(CASE WHEN type = 'Save' THEN amount END), 0) AS DOUBLE) AS save_total, count(*) AS found
FROM found_opportunities GROUP BY brand""")
PARTS["tier_all"] = """SELECT count(*) AS products, count(CASE WHEN tier = 'Pause' THEN 1 END) AS pause_products,
 CAST(coalesce(sum(CAST(CASE WHEN tier = 'Pause' THEN spend END AS DECIMAL(28,6))), 0) AS DOUBLE) AS pause_spend FROM scored"""
PARTS["facts_all"] = f"""SELECT *, {pos("total_spend", "rev", 2, True)} AS tacos FROM (
 SELECT *, coalesce(nullif(total_ordered_revenue, 0), total_ad_sales, 0) AS rev FROM kpi CROSS JOIN vkpi CROSS JOIN tier_all)"""
oracle("narrative_facts", """
SELECT 1 AS paragraph, 'overview' AS subject, CASE WHEN overall_acos <> 0 AND overall_acos <= 25 THEN 'positive'
  WHEN overall_acos <> 0 AND overall_acos <= 35 THEN 'neutral' ELSE 'warning' END AS sentiment, nullif(overall_acos, 0) AS value,
 CASE WHEN tacos <= 10 THEN 'healthy' WHEN tacos <= 18 THEN 'dependent' WHEN tacos > 18 THEN 'critical' END AS note
 FROM facts_all WHERE total_spend > 0 AND rev > 0
UNION ALL SELECT 2, 'efficiency', CASE WHEN overall_roas >= 4 THEN 'positive' WHEN overall_roas >= 2 THEN 'neutral' ELSE 'critical' END,
 overall_roas, CASE WHEN conversion_rate >= 12 THEN 'converts well' WHEN conversion_rate >= 7 THEN 'converts soundly'
  WHEN conversion_rate IS NOT NULL THEN 'converts poorly' END FROM facts_all WHERE overall_roas IS NOT NULL
UNION ALL SELECT 3, 'visibility', CASE WHEN overall_ctr >= 0.5 THEN 'positive' WHEN overall_ctr >= 0.35 THEN 'neutral'
  WHEN overall_ctr IS NULL THEN 'neutral' ELSE 'warning' END, overall_ctr,
 CASE WHEN ntb_order_pct >= 40 THEN 'strong acquisition' WHEN ntb_order_pct > 0 THEN 'moderate acquisition' END
 FROM facts_all WHERE total_impressions > 0 AND total_clicks > 0
UNION ALL SELECT 4, 'growth', 'neutral', incremental_spend, NULL FROM plan_all WHERE scenario_id = '+10%'
UNION ALL SELECT 5, 'portfolio', CASE WHEN pause_products = 0 THEN 'positive' WHEN pause_products <= products * 0.2 THEN 'warning'
  ELSE 'critical' END, pause_spend, NULL FROM facts_all""")
oracle("health_alerts", union([
    f"SELECT asin, '{rule}' AS rule, '{kind}' AS kind, {v} AS value FROM kpi_asin WHERE {cond}"
    for rule, kind, v, cond in [
        ("acos_high", "alert", "overall_acos", "overall_acos > 35"), ("acos_low", "good", "overall_acos", "overall_acos < 15"),
        ("acos_healthy", "good", "overall_acos", "overall_acos BETWEEN 15 AND 35"),
        ("roas_low", "alert", "overall_roas", "overall_roas < 2"), ("roas_strong", "good", "overall_roas", "overall_roas >= 4"),
        ("ctr_low", "alert", "overall_ctr", "overall_ctr < 0.3"), ("cpc_high", "alert", "overall_cpc", "overall_cpc > 2.5"),
        ("ntb_strong", "good", "ntb_order_pct", "ntb_order_pct > 50")]]))

# --- streams --------------------------------------------------------------------------------------------------------------------------------------------

PARTS["live_events"] = f"""SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS dim,
 CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS impressions, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicks,
 CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS ad_orders, 0 AS ad_orders_ntb, 0 AS sales_ntb, 0 AS ad_sales_longterm,
 {dec("CASE WHEN event_type = 'click' THEN value / 10 ELSE 0 END")} AS spend,
 {dec("CASE WHEN event_type = 'purchase' THEN value ELSE 0 END")} AS ad_sales FROM events"""
oracle("stream_trend", f"""
SELECT *, {TREND_RATIOS} FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS period_start, {sums(CORE)}
 FROM live_events GROUP BY ALL)""")
oracle("stream_trend_months", f"""
SELECT *, {TREND_RATIOS} FROM (SELECT CAST(date_trunc('month', happened) AS DATE) AS period_start, {sums(CORE)}
 FROM (SELECT *, ts + CAST(event_id % 4 AS INTEGER) * INTERVAL 1 MONTH AS happened FROM live_events) GROUP BY ALL)
WHERE period_start < (SELECT date_trunc('month', max(ts + CAST(event_id % 4 AS INTEGER) * INTERVAL 1 MONTH)) FROM live_events)""")
oracle("replace_month", f"""
SELECT CAST(date_trunc('month', report_date) AS DATE) AS month,
 {s("CASE WHEN report_date BETWEEN DATE '1996-02-01' AND DATE '1996-03-31' THEN 2 ELSE 1 END * spend")} AS spend, {s("ad_sales")} AS ad_sales
FROM ads GROUP BY 1""")
oracle("stream_kpis", kpi("dim").replace("FROM ads", "FROM live_events"))

# The outer joins are about products of one report only; elsewhere the reports hold every line.
for _name in ("merge_asin_view", "plan_asins", "health_with_vendor"):
    ORACLES[_name] = (ORACLES[_name].replace(PARTS["ads"], PARTS["ads"] + " WHERE l_partkey % 7 <> 0")
                      .replace(PARTS["ven"], PARTS["ven"] + " WHERE l_partkey % 10 <> 0"))
