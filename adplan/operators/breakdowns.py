"""Sums by one dimension with the ratios over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adplan.functions.numeric import aliased, have, joined, positive_ratio, ratio, summable, total
from adplan.functions.schema import (
    CAMPAIGN_DIMENSIONS,
    CORE_MEASURES,
    FULL_MEASURES,
    PRODUCT_ATTRIBUTES,
    VENDOR_MEASURES,
)
from adplan.operators.attach import attach
from adplan.operators.ratios import add_ntb_pct, add_ratios
from adplan.operators.summary import IDLE, summarise
from adplan.operators.topk import ranked, top_n


def breakdown(df: DataFrame, dim: str, measures: Sequence[str] = CORE_MEASURES,
              by: Sequence[str] = (), attributes: Sequence[str] = (),
              keep_null: bool = False) -> DataFrame:
    """Sum the present measures by one dimension.

    ``attributes`` adds one value per key (the smallest non-null one, which does not
    depend on row order). Rows without a key are left out unless ``keep_null`` is set.
    With no measure present the result is the list of keys. Without the dimension in the report it is an
    empty table of the same columns.
    """
    if dim not in df.columns:
        df = df.withColumn(dim, F.lit(None).cast("string")).filter(F.lit(False))
    rows = df if keep_null else df.filter(F.col(dim).isNotNull())
    keys = [*by, dim]
    texts = [a for a in have(df, attributes) if a not in keys]
    names = have(df, measures)
    if not texts and not names:
        return rows.select(*keys).distinct()
    if not texts:
        rows, sums = summable(rows, names, keys)
        return rows.groupBy(*keys).agg(*aliased(sums))
    # Text minima keep Spark from aggregating by hash. Grouping by the texts first leaves
    # about one row per key for the aggregation that takes the minima.
    if not names:
        return rows.select(*keys, *texts).distinct().groupBy(*keys).agg(*[F.min(a).alias(a) for a in texts])
    rows, _ = summable(rows, names, [*keys, *texts])
    fields = [c for c in rows.columns if c not in (*keys, *texts)]
    first = rows.groupBy(*keys, *texts).agg(*[F.sum(f).alias(f) for f in fields])
    return first.groupBy(*keys).agg(
        *[joined([f"sum(`{f}`)" for f in fields if f.rsplit("__", 1)[0] == n]).alias(n) for n in names],
        *[F.min(a).alias(a) for a in texts])


def sorted_by(df: DataFrame, metric: str, key: str) -> DataFrame:
    return df.orderBy(*ranked(metric, [key])) if metric in df.columns else df


def campaign_dimension(df: DataFrame) -> str:
    present = have(df, CAMPAIGN_DIMENSIONS)
    if not present:
        raise ValueError("the report has no campaign dimension")
    return present[0]


def campaign_breakdown(df: DataFrame, dim: str | None = None, by: Sequence[str] = (),
                       ordered: bool = True) -> DataFrame:
    """By campaign, or by the nearest dimension the report has; highest spend first."""
    dim = dim or next(iter(have(df, CAMPAIGN_DIMENSIONS)), CAMPAIGN_DIMENSIONS[0])
    out = add_ratios(breakdown(df, dim, CORE_MEASURES, by))
    return sorted_by(out, "spend", dim) if ordered else out


def asin_ads_breakdown(df: DataFrame, by: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """By product; highest ad sales first."""
    out = add_ratios(breakdown(df, "asin", CORE_MEASURES, by))
    return sorted_by(out, "ad_sales", "asin") if ordered else out


def asin_vendor_breakdown(df: DataFrame, by: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """Vendor revenue and units by product, with attributes and the average price."""
    out = breakdown(df, "asin", VENDOR_MEASURES, by, ("product_title", "category", "brand"))
    if {"ordered_units", "ordered_revenue"} <= set(out.columns):
        out = out.withColumn("avg_price", ratio(F.col("ordered_revenue"), F.col("ordered_units"), 2))
    return sorted_by(out, "ordered_revenue", "asin") if ordered else out


def match_type_breakdown(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sorted_by(add_ratios(breakdown(df, "match_type", CORE_MEASURES, by)), "spend", "match_type")


def bid_strategy_breakdown(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sorted_by(add_ratios(breakdown(df, "bid_strategy", CORE_MEASURES, by)), "spend", "bid_strategy")


def category_breakdown(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sorted_by(add_ratios(breakdown(df, "category", CORE_MEASURES, by)), "ad_sales", "category")


def ad_product_breakdown(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """By ad product, with each one's share of spend."""
    out = breakdown(df, "campaign_type", CORE_MEASURES, by).withColumnRenamed("campaign_type", "ad_product")
    out = add_ratios(out)
    if "spend" not in out.columns:
        return out
    # The whole is the sum of the few rows above, not of the report.
    whole = (out.groupBy(*by) if by else out).agg(total(out, "spend", wide=True).alias("__whole"))
    share = F.coalesce(positive_ratio(F.col("spend"), F.col("__whole"), 1, 100.0), F.lit(0.0))
    out = attach(out, whole, by).withColumn("spend_share_pct", share).drop("__whole")
    return sorted_by(out, "spend", "ad_product")


def search_term_breakdown(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return add_ntb_pct(add_ratios(breakdown(df, "search_term", FULL_MEASURES, by)))


def product_breakdown(df: DataFrame, by: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """Every measure by product with its attributes; highest ad sales first."""
    out = add_ratios(breakdown(df, "asin", FULL_MEASURES, by, PRODUCT_ATTRIBUTES))
    out = add_ntb_pct(out)
    return sorted_by(out, "ad_sales", "asin") if ordered else out


BULK_DIMENSIONS = {"campaign": None, "asin": "asin", "match_type": "match_type",
                   "bid_strategy": "bid_strategy", "ad_product": "campaign_type"}


def bulk_dimensions(df: DataFrame) -> dict[str, str]:
    """The dimensions of :func:`all_breakdowns` that the report has."""
    dims = {n: (campaign_dimension(df) if c is None and have(df, CAMPAIGN_DIMENSIONS) else c)
            for n, c in BULK_DIMENSIONS.items()}
    return {n: c for n, c in dims.items() if c in df.columns}


def all_breakdowns(df: DataFrame) -> DataFrame:
    """Five breakdowns in one scan and one shuffle, as one long table.

    Result: ``dimension, key`` and the measures with their ratios. Partial aggregation
    folds the rows of each grouping set before they move. Write it
    ``partitionBy("dimension")`` to read single breakdowns back.
    """
    long = summarise(df, bulk_dimensions(df), measures=FULL_MEASURES, account=False)
    return add_ratios(long.drop(IDLE))


# --- heads of the search-term and product tables -------------------------------------

def wasted_rows(df: DataFrame) -> DataFrame:
    """Rows without an order."""
    return df.filter(F.coalesce(F.col("ad_orders"), F.lit(0)) == 0)


def converting_terms(terms: DataFrame) -> DataFrame:
    return terms.filter(F.col("ad_sales") > 0)


def idle_terms(terms: DataFrame) -> DataFrame:
    return wasted_rows(terms).filter(F.col("spend") > 0)


def ntb_terms(terms: DataFrame) -> DataFrame:
    return terms.filter(F.col("ntb_pct").isNotNull() & (F.col("ad_orders") >= 2))


def harvest_terms(terms: DataFrame) -> DataFrame:
    return terms.filter((F.col("cvr_pct") >= 5) & (F.col("spend") > 0))


def top_converting(terms: DataFrame, n: int = 20, by: Sequence[str] = ()) -> DataFrame:
    return top_n(converting_terms(terms), "ad_sales", n, ["search_term"], by)


def wasted_terms(terms: DataFrame, n: int = 20, by: Sequence[str] = ()) -> DataFrame:
    return top_n(idle_terms(terms), "spend", n, ["search_term"], by)


def ntb_leaders(terms: DataFrame, n: int = 20, by: Sequence[str] = ()) -> DataFrame:
    return top_n(ntb_terms(terms), "ntb_pct", n, ["search_term"], by)


def harvest_candidates(terms: DataFrame, n: int = 15, by: Sequence[str] = ()) -> DataFrame:
    return top_n(harvest_terms(terms), "cvr_pct", n, ["search_term"], by)


def top_roas(products: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    return top_n(products.filter(F.col("roas").isNotNull()), "roas", n, ["asin"], by)


def worst_acos(products: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    return top_n(products.filter(F.col("acos_pct").isNotNull()), "acos_pct", n, ["asin"], by)


def campaign_outliers(campaigns: DataFrame) -> DataFrame:
    """Campaigns far off: very high ACOS, or real spend without sales."""
    high = F.coalesce((F.col("acos_pct") > 80) & (F.col("spend") > 100), F.lit(False))
    none = (F.coalesce(F.col("roas"), F.lit(0.0)) == 0) & (F.col("spend") > 50)
    return (campaigns.withColumn("high_acos", high).withColumn("zero_roas", none)
            .filter("high_acos or zero_roas"))
