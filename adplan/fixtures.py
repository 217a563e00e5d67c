"""Advertising and vendor reports seen through the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adplan.operators.ingest import normalise_campaign_type
from adplan.sources.tables import table

SOLD = "l_linestatus = 'F' AND p_size % 10 <> 0"
NEW_BUYER = f"{SOLD} AND (o_orderstatus = 'P' OR p_size % 3 = 0)"
# At least nine digits, more where the key has more.
PRODUCT = "concat('B', lpad(string(l_partkey), greatest(9, length(string(l_partkey))), '0'))"


def amount(x: str) -> str:
    """A measure with four decimals."""
    return f"rint(({x}) * 10000) / 10000"


def raw_ads(spark: SparkSession, folder: str, one_sided: bool = False) -> DataFrame:
    """One row per line item, shaped like an advertising report; ad products not yet normalised.

    one_sided leaves some products to the vendor report alone, which is what the outer join is about.
    """
    lines = table(spark, folder, "lineitem")
    lines = lines.filter("l_partkey % 7 <> 0") if one_sided else lines
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.selectExpr(
        "l_orderkey", "l_linenumber", "CAST(l_shipdate AS DATE) AS report_date",
        f"{PRODUCT} AS asin",
        "concat('camp-', l_suppkey) AS campaign_name",
        "CASE l_returnflag WHEN 'R' THEN ' SP ' WHEN 'A' THEN 'Headline Search Ads' "
        "ELSE 'sponsored display (sd)' END AS campaign_type",
        "CASE l_linenumber % 3 WHEN 0 THEN 'Exact' WHEN 1 THEN 'Phrase' ELSE 'Broad' END AS match_type",
        "o_orderpriority AS bid_strategy", "concat(p_name, ' ', p_size) AS search_term",
        "p_name AS product_title", "p_type AS category", "p_brand AS brand",
        f"{amount('l_quantity * 100 * (1 + l_linenumber)')} AS impressions",
        f"{amount('ceil(l_quantity / (1 + p_size % 8))')} AS clicks",
        f"{amount('l_extendedprice * l_discount * (1 + p_size % 7)')} AS spend",
        f"{amount(f'CASE WHEN {SOLD} THEN l_extendedprice ELSE 0 END')} AS ad_sales",
        f"{amount(f'CASE WHEN {SOLD} THEN 1 ELSE 0 END')} AS ad_orders",
        f"{amount(f'CASE WHEN {NEW_BUYER} THEN 1 ELSE 0 END')} AS ad_orders_ntb",
        f"{amount(f'CASE WHEN {NEW_BUYER} THEN l_extendedprice ELSE 0 END')} AS sales_ntb",
        f"{amount(f'CASE WHEN {SOLD} THEN l_extendedprice * (1 + l_tax) ELSE 0 END')} AS ad_sales_longterm",
    )


def ads(spark: SparkSession, folder: str, one_sided: bool = False) -> DataFrame:
    return normalise_campaign_type(raw_ads(spark, folder, one_sided))


def vendor(spark: SparkSession, folder: str, with_price: bool = False, one_sided: bool = False) -> DataFrame:
    """One row per line item, shaped like a vendor sales report; one_sided leaves some products to the ads alone."""
    lines = table(spark, folder, "lineitem")
    lines = lines.filter("l_partkey % 10 <> 0") if one_sided else lines
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    price = [f"{amount('p_retailprice')} AS avg_selling_price"] if with_price else []
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        f"{PRODUCT} AS asin", "CAST(l_shipdate AS DATE) AS report_date",
        "p_name AS product_title", "p_type AS category", "p_brand AS brand",
        f"{amount('l_extendedprice')} AS ordered_revenue",
        f"{amount('l_extendedprice * (1 - l_discount)')} AS shipped_revenue",
        f"{amount('l_quantity')} AS ordered_units",
        f"{amount("CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END")} AS shipped_units",
        f"{amount('l_quantity * 20')} AS glance_views",
        *price,
    )


def event_measures(events: DataFrame) -> DataFrame:
    """Advertising measures carried by single user events."""
    return events.selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type AS dim",
        "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS impressions",
        "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicks",
        "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS ad_orders",
        f"{amount("CASE WHEN event_type = 'click' THEN value / 10 ELSE 0 END")} AS spend",
        f"{amount("CASE WHEN event_type = 'purchase' THEN value ELSE 0 END")} AS ad_sales",
    )
