"""Derived efficiency columns over already aggregated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adplan.functions import labels
from adplan.functions.numeric import ratio


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def add_ratios(df: DataFrame) -> DataFrame:
    """ACOS, ROAS, CPC and conversion rate, each where its inputs are present."""
    spend, sales, clicks, orders = (F.col(c) for c in ("spend", "ad_sales", "clicks", "ad_orders"))
    new = {}
    if _has(df, "spend", "ad_sales"):
        new["acos_pct"] = ratio(spend, sales, 2, 100.0)
        new["roas"] = ratio(sales, spend, 2)
    if _has(df, "spend", "clicks"):
        new["cpc"] = ratio(spend, clicks, 4)
    if _has(df, "clicks", "ad_orders"):
        new["cvr_pct"] = ratio(orders, clicks, 2, 100.0)
    return df.withColumns(new) if new else df


def add_ctr(df: DataFrame) -> DataFrame:
    if not _has(df, "clicks", "impressions"):
        return df
    return df.withColumn("ctr_pct", ratio(F.col("clicks"), F.col("impressions"), 4, 100.0))


def add_ntb_pct(df: DataFrame) -> DataFrame:
    """Share of orders from customers new to the brand."""
    if not _has(df, "ad_orders", "ad_orders_ntb"):
        return df
    return df.withColumn("ntb_pct", ratio(F.col("ad_orders_ntb"), F.col("ad_orders"), 1, 100.0))


def metric_bands(df: DataFrame, acos: str = "acos_pct", roas: str = "roas") -> DataFrame:
    """Label columns for ACOS and ROAS."""
    new = {}
    if acos in df.columns:
        new["acos_band"] = labels.acos_band(F.col(acos))
        new["acos_colour"] = labels.acos_colour(F.col(acos))
    if roas in df.columns:
        new["roas_band"] = labels.roas_band(F.col(roas))
    return df.withColumns(new) if new else df


def with_delta(df: DataFrame, new: str, old: str, higher_is_better: bool = True,
               points: bool = False) -> DataFrame:
    """Change, direction and verdict between two columns."""
    d = labels.delta(F.col(new), F.col(old), higher_is_better, points)
    return df.withColumn("__d", d).select(*df.columns, "__d.change", "__d.direction", "__d.is_good")
