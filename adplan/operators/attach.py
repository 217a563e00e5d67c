"""Bring per-entity values (totals, KPIs, quartiles) next to the rows of the entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Left-join ``facts`` (one row per ``by`` key) to ``df``.

    Without ``by`` the single row of ``facts`` comes in as a scalar subquery, so no join
    and no shuffle is planned. With ``by`` it is a plain join by the entity: adaptive execution
    broadcasts ``facts`` when its measured size allows it and splits an entity that owns a
    large share of all rows.
    """
    values = [c for c in facts.columns if c not in by]
    if not by:
        row = facts.select(F.struct(*values).alias("row")).scalar()
        return df.select("*", *[row[c].alias(c) for c in values])

    right = facts.select(*[F.col(k).alias(f"__{k}") for k in by], *values)
    match = None
    for k in by:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        match = same if match is None else match & same
    return df.join(right, match, "left").select(*df.columns, *values)


def attach_totals(df: DataFrame, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Add totals over all rows, or over the rows of each entity."""
    exprs = [c.alias(n) for n, c in sums.items()]
    grouped = df.groupBy(*by) if by else df
    return attach(df, grouped.agg(*exprs), by)
