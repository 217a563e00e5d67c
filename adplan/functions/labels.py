"""Bands, tiers and signed changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ("Scale", "Optimise", "Review", "Pause")


def ladder(c: Column, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """First step whose lower limit is reached, tried from the first to the last."""
    (limit, value), *rest = steps
    out = F.when(c >= F.lit(limit), F.lit(value))
    for limit, value in rest:
        out = out.when(c >= F.lit(limit), F.lit(value))
    return out.otherwise(F.lit(otherwise))


def ceiling_ladder(c: Column, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """First step whose upper limit is not exceeded."""
    (limit, value), *rest = steps
    out = F.when(c <= F.lit(limit), F.lit(value))
    for limit, value in rest:
        out = out.when(c <= F.lit(limit), F.lit(value))
    return out.otherwise(F.lit(otherwise))


def tier(score: Column) -> Column:
    return ladder(score, [(80.0, "Scale"), (55.0, "Optimise"), (35.0, "Review")], "Pause")


def grade(score: Column) -> Column:
    return ladder(score, [(80.0, "Excellent"), (60.0, "Good"), (40.0, "Fair")], "Needs Work")


def acos_band(acos: Column) -> Column:
    """Efficient up to 20, acceptable up to 35, else high; no label for null and 0."""
    named = ceiling_ladder(acos, [(20.0, "Efficient"), (35.0, "Acceptable")], "High")
    return F.when(acos != 0, named)


def roas_band(roas: Column) -> Column:
    """Strong from 4, adequate from 2, else low; no label for null and 0."""
    named = ladder(roas, [(4.0, "Strong"), (2.0, "Adequate")], "Low")
    return F.when(roas != 0, named)


def acos_colour(acos: Column) -> Column:
    """Green below 20, amber below 35, else red."""
    colour = F.when(acos < 20, "green").when(acos < 35, "amber").otherwise("red")
    return F.when(acos.isNotNull(), colour)


def delta(new: Column, old: Column, higher_is_better: bool = True, points: bool = False) -> Column:
    """Change from ``old`` to ``new`` as ``struct<change, direction, is_good>``.

    The change is in percent of ``|old|``, or in points. Changes inside the dead band
    (0.01 % or 0.001 points), from a missing value, and percentages of 0 are neutral:
    direction ``flat`` and no verdict.
    """
    new = F.coalesce(new, F.lit(0.0))
    diff = new - old
    pct = F.coalesce(F.try_divide(diff, F.abs(old)) * 100, F.lit(0.0))
    change = diff if points else pct
    band = 0.001 if points else 0.01
    moved = old.isNotNull() & (F.abs(change) >= band)
    better = (diff > 0) if higher_is_better else (diff <= 0)
    return F.struct(
        F.when(moved, change).alias("change"),
        F.when(moved, F.when(diff > 0, "up").otherwise("down")).otherwise("flat").alias("direction"),
        F.when(moved, better).alias("is_good"),
    )
