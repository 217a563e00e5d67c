"""From raw all-text report tables to the canonical typed schema."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from adplan.functions import text
from adplan.functions.numeric import have, text_to_number
from adplan.functions.schema import (
    ADS_ALIASES,
    ADS_SIGNALS,
    NUMERIC_COLUMNS,
    TEXT_COLUMNS,
    VENDOR_ALIASES,
    VENDOR_SIGNALS,
)


def normalise_columns(df: DataFrame, aliases: Mapping[str, str], blank_tokens: bool = False) -> DataFrame:
    """Rename headers to canonical names in one projection.

    Headers are trimmed and lower-cased first; unknown ones pass through under that
    name. Several headers of one canonical column merge: first non-null in header order.
    ``blank_tokens`` turns the no-value tokens of text cells into nulls before that.
    """
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    if blank_tokens:
        positional = positional.select([
            text.blank_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
            for f in positional.schema.fields
        ])
    sources: dict[str, list[str]] = defaultdict(list)
    for i, header in enumerate(df.columns):
        name = header.lstrip("﻿").strip().lower()
        sources[aliases.get(name, name)].append(f"c{i}")
    return positional.select([
        (F.coalesce(*[F.col(c) for c in cs]) if len(cs) > 1 else F.col(cs[0])).alias(name)
        for name, cs in sources.items()
    ])


def clean_numeric(df: DataFrame) -> DataFrame:
    """Known numeric columns to DOUBLE: currency and percent signs stripped, junk to null."""
    texts = [f.name for f in df.schema.fields if f.name in NUMERIC_COLUMNS and isinstance(f.dataType, StringType)]
    others = [F.col(f"`{f.name}`").cast("double").alias(f.name) if f.name in NUMERIC_COLUMNS and isinstance(f.dataType, NumericType)
              else F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in texts]
    if not texts:
        return df.select(others)
    # One generator for all cells: whatever reads a number reads it, rather than the expression it comes from.
    cells = F.explode(F.array(F.struct(*[text_to_number(F.col(f"`{n}`")).alias(n) for n in texts]))).alias("__cells")
    return df.select(*others, cells).select([F.col(f"__cells.`{n}`" if n in texts else f"`{n}`").alias(n) for n in df.columns])


def infer_numeric(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Convert unknown text columns that are mostly formatted numbers.

    A column converts when some value carries ``$``, ``%`` or ``,`` and at least
    ``share`` of its non-null values are numbers. The statistics of all candidates come
    from one aggregation over the whole table.
    """
    known = TEXT_COLUMNS | NUMERIC_COLUMNS
    candidates = [f.name for f in df.schema.fields
                  if isinstance(f.dataType, StringType) and f.name not in known]
    if not candidates:
        return df
    stats = []
    for i, name in enumerate(candidates):
        c = df[f"`{name}`"]
        stats += [
            F.max(c.rlike(r"[$%,]")).alias(f"sign{i}"),
            F.count(c).alias(f"filled{i}"),
            F.count(text_to_number(c)).alias(f"number{i}"),
        ]
    seen = df.agg(*stats).first()
    convert = {name for i, name in enumerate(candidates)
               if seen[f"sign{i}"] and seen[f"number{i}"] >= share * seen[f"filled{i}"]}
    return df.select([
        text_to_number(df[f"`{n}`"]).alias(n) if n in convert else df[f"`{n}`"] for n in df.columns
    ])


def normalise_campaign_type(df: DataFrame, null_label: str | None = None) -> DataFrame:
    """Bring the spellings of the ad products to one name each."""
    if "campaign_type" not in df.columns:
        return df
    return df.withColumn("campaign_type", text.campaign_type(F.col("campaign_type"), null_label))


def vendor_period_to_date(df: DataFrame) -> DataFrame:
    """Use the vendor report's period as its report date, unless it has one."""
    if "period" in df.columns and "report_date" not in df.columns:
        return df.withColumnRenamed("period", "report_date")
    return df


def parse_ads(df: DataFrame, infer: bool = True) -> DataFrame:
    """Raw advertising report -> canonical typed table."""
    out = (df.transform(normalise_columns, ADS_ALIASES, True)
             .transform(normalise_campaign_type)
             .transform(clean_numeric))
    return infer_numeric(out) if infer else out


def parse_vendor(df: DataFrame, infer: bool = True) -> DataFrame:
    """Raw vendor sales report -> canonical typed table."""
    out = (df.transform(normalise_columns, VENDOR_ALIASES, True)
             .transform(vendor_period_to_date)
             .transform(clean_numeric))
    return infer_numeric(out) if infer else out


def missing_columns(df: DataFrame, kind: str) -> list[str]:
    """Required columns that a parsed report lacks (metadata only)."""
    if kind == "ads":
        return [c for c in ("spend", "ad_sales") if c not in df.columns]
    if have(df, ["ordered_revenue", "shipped_revenue"]):
        return []
    return ["ordered_revenue"]


def validate(df: DataFrame, kind: str) -> DataFrame:
    """Row count and missing required columns of a parsed report, as one row."""
    missing = missing_columns(df, kind)
    names = F.array(*[F.lit(c) for c in missing]) if missing else F.array().cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(kind).alias("kind"),
        "row_count",
        F.array_join(names, ",").alias("missing"),
        F.lit(not missing).alias("is_valid"),
    )


def classify_reports(headers: DataFrame, header_col: str = "headers") -> DataFrame:
    """Tell vendor from advertising reports by their headers.

    ``headers`` has one row per file with an array of header texts. A file is a vendor
    report only when it shows strictly more vendor headers than advertising headers.
    """
    shown = F.transform(F.col(header_col), lambda h: F.lower(F.trim(h)))

    def hits(signals: tuple[str, ...]):
        return F.size(F.array_intersect(shown, F.array(*[F.lit(s) for s in signals])))

    return (headers
            .withColumn("vendor_hits", hits(VENDOR_SIGNALS))
            .withColumn("ads_hits", hits(ADS_SIGNALS))
            .withColumn("kind", F.when(F.col("vendor_hits") > F.col("ads_hits"), "vendor")
                        .otherwise("ads")))
