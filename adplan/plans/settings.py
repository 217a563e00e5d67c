"""Planning inputs: growth scenarios, channel split, event calendar."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default share of each channel.
DEFAULT_SPLIT: dict[str, float] = {
    "Sponsored Products": 0.65,
    "Sponsored Brands": 0.25,
    "Sponsored Display": 0.10,
}

# Relative rise of ACOS per 10 % growth, ad share of revenue when unknown
# and at most, ACOS when unknown.
ACOS_DECAY = 0.04
UNKNOWN_AD_SHARE = 0.40
MAX_AD_SHARE = 0.90
UNKNOWN_ACOS = 20.0

# Months with their events (badge, name) and spend multiplier.
CALENDAR: list[tuple[int, str, list[tuple[str, str]], float]] = [
    (1, "Jan", [("🎉", "New Year Deals")], 1.0),
    (2, "Feb", [("💝", "Valentine's Day")], 1.10),
    (3, "Mar", [("🌸", "Spring Sale")], 1.0),
    (4, "Apr", [], 1.0),
    (5, "May", [("💐", "Mother's Day")], 1.08),
    (6, "Jun", [("👔", "Father's Day"), ("☀️", "Mid-Year Sale")], 1.08),
    (7, "Jul", [("⚡", "Prime Day"), ("🌞", "Summer Sale")], 1.30),
    (8, "Aug", [("🎒", "Back to School")], 1.05),
    (9, "Sep", [], 1.0),
    (10, "Oct", [("🍂", "Pre-Holiday Push"), ("⚡", "Prime Big Deal Days")], 1.20),
    (11, "Nov", [("🛒", "Black Friday"), ("💻", "Cyber Monday")], 1.45),
    (12, "Dec", [("🎄", "Holiday Season"), ("🎁", "Year-End Sale")], 1.25),
]
NO_EVENT = "—"
EVENT_SEPARATOR = " · "


@dataclass(frozen=True)
class Scenario:
    """One growth target; a pinned metric takes the place of its derivation."""

    scenario_id: str
    growth_pct: float = 0.0
    target_revenue: float | None = None
    ad_spend: float | None = None
    ad_sales: float | None = None
    roas: float | None = None
    tacos: float | None = None

    @property
    def is_custom(self) -> bool:
        return any([self.target_revenue, self.ad_spend, self.ad_sales, self.roas, self.tacos])

    def literal(self) -> Column:
        def number(x: float | None) -> Column:
            return F.lit(None if x is None else float(x)).cast("double")

        return F.struct(
            F.lit(self.scenario_id).alias("scenario_id"),
            number(self.growth_pct).alias("asked_growth_pct"),
            number(self.target_revenue).alias("pin_revenue"),
            number(self.ad_spend).alias("pin_spend"),
            number(self.ad_sales).alias("pin_sales"),
            number(self.roas).alias("pin_roas"),
            number(self.tacos).alias("pin_tacos"),
            F.lit(self.is_custom).alias("is_custom"),
        )


def growth_scenarios(percentages: Sequence[float] = (10, 20, 30)) -> list[Scenario]:
    return [Scenario(f"+{p:g}%", float(p)) for p in percentages]


def scenario_rows(scenarios: Sequence[Scenario]) -> Column:
    """The scenarios as an array literal, to explode next to each entity: no join needed."""
    return F.array(*[s.literal() for s in scenarios])


def normalise_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """Shares that add up to 1; the default split when all weights are 0."""
    whole = sum(weights.values())
    return {c: w / whole for c, w in weights.items()} if whole else dict(DEFAULT_SPLIT)


def channel_rows(split: Mapping[str, float]) -> Column:
    return F.array(*[
        F.struct(F.lit(c).alias("channel"), F.lit(float(w)).alias("weight")) for c, w in split.items()
    ])


def calendar_rows() -> Column:
    """Twelve months with label, event flag, multiplier and seasonal weight, as an array literal."""
    whole = sum(m for *_, m in CALENDAR)
    return F.array(*[
        F.struct(
            F.lit(no).alias("month"), F.lit(name).alias("month_name"),
            F.lit(EVENT_SEPARATOR.join(f"{badge} {event}" for badge, event in events) or NO_EVENT).alias("events"),
            F.lit(bool(events)).alias("is_event_month"),
            F.lit(mult).alias("multiplier"), F.lit(mult / whole).alias("weight"),
        )
        for no, name, events, mult in CALENDAR
    ])
