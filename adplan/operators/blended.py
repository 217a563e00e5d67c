"""Advertising and vendor figures of a product side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adplan.functions.numeric import have, ratio
from adplan.operators.breakdowns import sorted_by


def merge_asin_view(ads: DataFrame | None, vendor: DataFrame | None, by: Sequence[str] = (),
                    ordered: bool = True) -> DataFrame:
    """Full outer join of two per-product tables, with TACOS.

    Columns that both sides carry get the suffixes ``_ads`` and ``_vendor``. Both sides
    hold one row per key, so no key can be hot. A missing side leaves the other unchanged.
    """
    if ads is None or vendor is None:
        return ads if vendor is None else vendor
    keys = [*by, "asin"]
    clash = (set(ads.columns) & set(vendor.columns)) - set(keys)
    left = ads.withColumnsRenamed({c: f"{c}_ads" for c in clash})
    right = vendor.withColumnsRenamed({c: f"{c}_vendor" for c in clash})
    out = left.join(right, keys, "full_outer")
    if {"spend", "ordered_revenue"} <= set(out.columns):
        out = out.withColumn("tacos_pct", ratio(F.col("spend"), F.col("ordered_revenue"), 2, 100.0))
    return sorted_by(out, "ordered_revenue", "asin") if ordered else out


def add_vendor_figures(products: DataFrame, vendor: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Left join of the vendor revenue and units onto a per-product table."""
    wanted = have(vendor, ["ordered_revenue", "shipped_revenue", "ordered_units"])
    if not wanted:
        return products
    return products.join(vendor.select(*by, "asin", *wanted), [*by, "asin"], "left")
