"""Canonical names of the two report kinds and the headers that map onto them."""

from __future__ import annotations

# Report header (trimmed, lower case) -> canonical advertising column.
ADS_ALIASES: dict[str, str] = {
    "impressions": "impressions",
    "viewable impressions": "viewable_impressions",
    "clicks": "clicks",
    "spend": "spend",
    "cost": "spend",
    "ad spend": "spend",
    "total spend": "spend",
    "total cost": "spend",
    "campaign budget amount": "campaign_budget",
    "sales": "ad_sales",
    "attributed sales": "ad_sales",
    "7 day total sales": "ad_sales",
    "14 day total sales": "ad_sales",
    "total attributed sales": "ad_sales",
    "ad sales": "ad_sales",
    "long-term sales": "ad_sales_longterm",
    "orders": "ad_orders",
    "purchases": "ad_orders",
    "attributed conversions": "ad_orders",
    "total orders": "ad_orders",
    "purchases (new to brand)": "ad_orders_ntb",
    "cost per purchase": "cpp",
    "cost per purchase (new to brand)": "cpp_ntb",
    "click-through rate (ctr)": "ctr",
    "ctr": "ctr",
    "viewable ctr (vctr)": "vctr",
    "cost per click (cpc)": "cpc",
    "cpc": "cpc",
    "acos": "acos",
    "advertising cost of sales (acos)": "acos",
    "total acos": "acos",
    "acos 14 days (%)": "acos",
    "acos (%)": "acos",
    "roas": "roas",
    "return on ad spend (roas)": "roas",
    "total roas": "roas",
    "long-term roas": "roas_longterm",
    "roas ($)": "roas",
    "ad spend ($)": "spend",
    "total ad spend ($)": "spend",
    "ad sales ($)": "ad_sales",
    "total ad sales ($)": "ad_sales",
    "14 day total sales ($)": "ad_sales",
    "7 day total sales ($)": "ad_sales",
    "cpc ($)": "cpc",
    "cost per click ($)": "cpc",
    "ctr (%)": "ctr",
    "click-through rate (%)": "ctr",
    "ad conversion 14 days (%)": "conversion_rate",
    "conversion rate (%)": "conversion_rate",
    "cvr (%)": "conversion_rate",
    "campaign name": "campaign_name",
    "ad group name": "ad_group_name",
    "targeting": "targeting",
    "targeting type": "match_type",
    "targeting match type": "match_type",
    "match type": "match_type",
    "target type": "target_type",
    "target status": "target_status",
    "target bid": "target_bid",
    "search term": "search_term",
    "matched target": "matched_target",
    "asin": "asin",
    "sku": "sku",
    "portfolio name": "portfolio_name",
    "campaign type": "campaign_type",
    "ad product": "campaign_type",
    "advertised asin": "asin",
    "advertised sku": "sku",
    "advertised product id": "asin",
    "advertised product name": "product_title",
    "advertised product brand": "brand",
    "advertised product category": "category",
    "advertised product subcategory": "subcategory",
    "title": "product_title",
    "campaign id": "campaign_id",
    "campaign bid strategy": "bid_strategy",
    "date range": "date_range",
    "start date": "start_date",
    "end date": "end_date",
    "report date": "report_date",
    "date": "report_date",
    "day": "report_date",
    "week": "week_date",
    "week ending": "week_date",
    "week start": "week_date",
    "month": "month_date",
    "reporting date": "report_date",
    "ad date": "report_date",
    "advertiser account id": "account_id",
    "advertiser account name": "account_name",
    "top-of-search impression share (is)": "tos_is",
    "percent of purchases new to brand": "pct_ntb_purchases",
    "percent of sales new to brand": "pct_ntb_sales",
    "sales (new to brand)": "sales_ntb",
    "brand": "brand",
}

# Report header (trimmed, lower case) -> canonical vendor column.
VENDOR_ALIASES: dict[str, str] = {
    "ordered revenue": "ordered_revenue",
    "ordered product sales": "ordered_revenue",
    "total ordered revenue": "ordered_revenue",
    "ops ($)": "ordered_revenue",
    "ops": "ordered_revenue",
    "ordered product sales ($)": "ordered_revenue",
    "total ops ($)": "ordered_revenue",
    "shipped revenue": "shipped_revenue",
    "shipped product sales": "shipped_revenue",
    "total shipped revenue": "shipped_revenue",
    "shipped cogs ($)": "shipped_revenue",
    "shipped cogs": "shipped_revenue",
    "ordered units": "ordered_units",
    "shipped units": "shipped_units",
    "total ordered units": "ordered_units",
    "total shipped units": "shipped_units",
    "units ordered": "ordered_units",
    "units shipped": "shipped_units",
    "average selling price ($)": "avg_selling_price",
    "average selling price": "avg_selling_price",
    "avg selling price ($)": "avg_selling_price",
    "avg. selling price ($)": "avg_selling_price",
    "glance views": "glance_views",
    "page views": "glance_views",
    "detail page views": "glance_views",
    "ad spend ($)": "spend",
    "ad sales ($)": "ad_sales",
    "roas ($)": "roas",
    "roas": "roas",
    "acos 14 days (%)": "acos",
    "acos (%)": "acos",
    "cpc ($)": "cpc",
    "ctr (%)": "ctr",
    "ad conversion 14 days (%)": "conversion_rate",
    "clicks": "clicks",
    "impressions": "impressions",
    "asin": "asin",
    "product title": "product_title",
    "product name": "product_title",
    "title": "product_title",
    "category": "category",
    "subcategory": "subcategory",
    "date": "period",
    "week": "period",
    "month": "period",
    "reporting period": "period",
    "report date": "period",
    "brand": "brand",
}

# Canonical columns that always stay text.
TEXT_COLUMNS = frozenset({
    "date_range", "start_date", "end_date", "report_date", "week_date",
    "month_date", "campaign_name", "ad_group_name", "search_term",
    "targeting", "matched_target", "product_title", "brand", "category",
    "subcategory", "account_name", "portfolio_name", "bid_strategy",
    "match_type", "target_type", "target_status", "campaign_type",
    "sku", "asin", "account_id", "campaign_id",
})

# Canonical columns that are always coerced to numbers.
NUMERIC_COLUMNS = frozenset({
    "impressions", "viewable_impressions", "clicks", "spend", "ad_sales",
    "ad_sales_longterm", "ad_orders", "ad_orders_ntb", "cpp", "cpp_ntb",
    "ctr", "vctr", "cpc", "acos", "roas", "roas_longterm",
    "campaign_budget", "target_bid", "pct_ntb_purchases", "pct_ntb_sales",
    "sales_ntb", "tos_is", "conversion_rate",
    "ordered_revenue", "shipped_revenue", "ordered_units", "shipped_units",
    "avg_selling_price", "glance_views",
})

# Cell texts that mean "no value".
NA_TOKENS = ("", "N/A", "n/a", "--", "—")

# Headers that mark a vendor report, and headers that mark an advertising report.
VENDOR_SIGNALS = (
    "ops ($)", "ops", "ordered_revenue", "ordered product sales",
    "shipped cogs ($)", "shipped cogs", "glance views", "glance_views",
    "units ordered", "ordered units", "average selling price ($)",
)
ADS_SIGNALS = (
    "brand", "targeting type", "campaign type", "campaign name",
    "ad group name", "targeting", "match type", "search term",
    "portfolio name", "campaign id", "bid strategy",
)

# Spellings of the three ad products.
CAMPAIGN_TYPES: dict[str, str] = {
    "sponsored products": "Sponsored Products",
    "sponsored products (sp)": "Sponsored Products",
    "sp": "Sponsored Products",
    "sponsored brands": "Sponsored Brands",
    "sponsored brands (sb)": "Sponsored Brands",
    "sb": "Sponsored Brands",
    "headline search ads": "Sponsored Brands",
    "sponsored display": "Sponsored Display",
    "sponsored display (sd)": "Sponsored Display",
    "sd": "Sponsored Display",
}

# Date-bearing columns, in the order in which they are preferred; date_range comes last.
# Date columns in order of preference.
DATE_COLUMNS = ("start_date", "report_date", "week_date", "month_date")

# Measures summed by the breakdowns.
CORE_MEASURES = ("spend", "ad_sales", "impressions", "clicks", "ad_orders")
FULL_MEASURES = CORE_MEASURES + ("ad_orders_ntb", "ad_sales_longterm")
VENDOR_MEASURES = ("ordered_revenue", "shipped_revenue", "ordered_units", "shipped_units")
PRODUCT_ATTRIBUTES = ("product_title", "category", "subcategory", "brand")

# Fall-back order of the campaign dimension.
# Campaign dimensions in order of preference.
CAMPAIGN_DIMENSIONS = ("campaign_name", "campaign_type", "targeting", "ad_group_name")
