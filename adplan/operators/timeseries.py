"""Weekly and monthly series."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adplan.functions.dates import Reading, date_readings, day_first, period_start, with_date, with_range_start
from adplan.functions.numeric import aliased, have, ratio, rnd, summable, totals
from adplan.functions.schema import CORE_MEASURES, DATE_COLUMNS
from adplan.operators.ratios import add_ctr, add_ratios


class DateChoice(NamedTuple):
    """The date column of a report, and whether numbers in it have the day first."""

    column: str
    day_first: bool


def _typed(df: DataFrame, name: str) -> bool:
    kind = dict(df.dtypes)[name]
    return kind == "date" or kind.startswith("timestamp")


def _read(df: DataFrame, name: str, out: str, day_first: bool | None) -> DataFrame:
    if _typed(df, name):
        return df.withColumn(out, F.col(name).cast("date"))
    return (with_range_start if name == "date_range" else with_date)(df, F.col(name), out, day_first)


def date_choice(df: DataFrame) -> DateChoice | None:
    """The date column to use for the whole table: the first, in order of preference, that holds any
    readable date; and the order of day and month in it, as its rows show.

    A probe stops at the first readable date it meets, so a good column costs next to nothing however large
    the table is. Cells too short for a date are not read. The last candidate needs no probe.
    """
    names = have(df, [*DATE_COLUMNS, "date_range"])
    if not names:
        return None
    column = names[-1]
    for name in names[:-1]:
        rows = df.select(name).filter(F.col(name).isNotNull() if _typed(df, name) else F.length(F.col(name).cast("string")) >= 6)
        either = [rows] if _typed(df, name) else [_read(rows, name, "__date", first).filter("__date is not null") for first in (False, True)]
        if any(not r.isEmpty() for r in either):
            column = name
            break
    return DateChoice(column, not _typed(df, column) and day_first(df, {column: column == "date_range"})[column])


def date_summary(df: DataFrame) -> DataFrame:
    """One row per date column of a report: filled, dated and undated rows, whether the day is first, and
    whether it is the column that `resolve_date` takes."""
    names = have(df, [*DATE_COLUMNS, "date_range"])
    texts = [n for n in names if not _typed(df, n)]
    found = date_readings(df, {n: n == "date_range" for n in texts}) if texts else {}
    if len(texts) < len(names):
        filled = df.agg(*[F.count(F.col(n)).alias(n) for n in names if n not in texts]).first()
        found |= {n: Reading(filled[n], filled[n], False) for n in names if n not in texts}
    chosen = next((n for n in names if found[n].dated), names[-1] if names else None)
    rows = [(n, found[n].filled, found[n].dated, found[n].undated, found[n].day_first, n == chosen) for n in names]
    return df.sparkSession.createDataFrame(rows, "column string, filled long, dated long, undated long, day_first boolean, chosen boolean")


def resolve_date(df: DataFrame, date_col: str | None = None, out: str = "date", day_first: bool | None = None,
                 keep_undated: bool = False) -> DataFrame:
    """Add the resolved date and drop the rows without one, unless they are to be kept (and counted)."""
    if date_col is None:
        choice = date_choice(df)
        if choice is None:
            raise ValueError("the report has no usable date column")
        date_col, day_first = choice.column, choice.day_first if day_first is None else day_first
    dated = _read(df, date_col, out, day_first)
    return dated if keep_undated else dated.filter(F.col(out).isNotNull())


def trend(df: DataFrame, freq: str = "W", by: Sequence[str] = (), date_col: str | None = None,
          ordered: bool = True) -> DataFrame:
    """Measures per week or month with the ratios over them."""
    dated = resolve_date(df, date_col, "__date")
    rows, sums = summable(dated.withColumn("period_start", period_start(F.col("__date"), freq)), CORE_MEASURES, [*by, "period_start"])
    summed = rows.groupBy(*by, "period_start").agg(*aliased(sums)) if sums else rows.distinct()
    out = add_ctr(add_ratios(summed)).drop("cvr_pct")
    return out.orderBy(*by, "period_start") if ordered else out


def trend_summary(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Change of the last period against the one before, per entity.

    Entities with fewer than two periods have no row.
    """
    names = {"spend": "spend_change_pct", "ad_sales": "sales_change_pct",
             "acos_pct": "acos_change_pct", "roas": "roas_change_pct"}
    present = have(series, names)
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("period_start").desc()))
        last = series.withColumn("__place", place).filter(F.col("__place") <= 2).drop("__place")
    else:
        last = series.orderBy(F.col("period_start").desc()).limit(2)
    pair = F.struct("period_start", *present)
    ends = (last.groupBy(*by) if by else last).agg(
        F.max(pair).alias("new"), F.min(pair).alias("old"), F.count(F.lit(1)).alias("__n"))

    def change(c: str) -> Column:
        new, old = F.col(f"new.{c}"), F.col(f"old.{c}")
        return rnd(F.try_divide(new - old, F.abs(old)) * 100, 1)

    return ends.filter(F.col("__n") == 2).select(
        *by, *[change(c).alias(names[c]) for c in present],
        F.col("new.period_start").alias("latest_period"), F.col("old.period_start").alias("prev_period"))


def ad_product_trend(df: DataFrame, freq: str = "M", by: Sequence[str] = (),
                     date_col: str | None = None) -> DataFrame:
    """Spend per period and ad product."""
    dated = resolve_date(df, date_col, "__date").filter(F.col("campaign_type").isNotNull())
    keys = [*by, "period_start", "campaign_type"]
    rows, sums = summable(dated.withColumn("period_start", period_start(F.col("__date"), freq)), ["spend"], keys)
    return rows.groupBy(*keys).agg(sums["spend"].alias("spend")).orderBy(*keys)


def peak_period(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The period with the highest ad sales; the earliest of equals."""
    rest = [c for c in series.columns if c not in by]
    rank = F.struct(F.col("ad_sales"), (-F.unix_date("period_start")).alias("early"))
    best = F.max_by(F.struct(*rest), rank).alias("best")
    known = series.filter(F.col("ad_sales").isNotNull())
    return (known.groupBy(*by) if by else known).agg(best).filter("best is not null").select(*by, "best.*")


def monthly_actuals(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Month sums of the latest year of each entity; ratios from the sums.

    The months of all years are summed first, so that the choice of the year runs over
    at most twelve rows per entity and year.
    """
    names = have(series, CORE_MEASURES)
    months = (series.groupBy(*by, F.year("period_start").alias("year"), F.month("period_start").alias("month"))
              .agg(*totals(series, names, wide=True)))
    months = months.withColumn("__latest", F.max("year").over(Window.partitionBy(*by)))
    out = months.filter(F.col("year") == F.col("__latest")).drop("__latest")
    spend, sales = F.col("spend"), F.col("ad_sales")
    if {"spend", "ad_sales"} <= set(names):
        both = (spend != 0) & (sales != 0)
        out = out.withColumns({
            "acos_pct": F.when(both, ratio(spend, sales, 2, 100.0)),
            "roas": F.when(both, ratio(sales, spend, 2)),
        })
    return out.orderBy(*by, "month")
