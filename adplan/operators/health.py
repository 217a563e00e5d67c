"""Product health scores, tiers and their distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adplan.functions import labels
from adplan.functions.numeric import finite, ratio
from adplan.operators.attach import attach
from adplan.operators.blended import add_vendor_figures
from adplan.sources.stage import settle

# Cells into which a pass cuts each bracket.
CELLS = 65_536


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, one row per entity, without gathering or sorting a group.

    Each wanted rank has a bracket of values that holds it, at first all of its entity's. A pass cuts the
    brackets of all entities into equal cells, counts the rows of each, and goes on with the smallest and largest
    value of the cell that the rank falls into, until these are one. Counts are over distinct values, which are
    written once; cells narrow as the values lie, so a million values take two or three passes. Nothing depends on
    the size of a group. Nulls and what is no amount count as 0. The passes run when this is called.
    """
    v = F.coalesce(finite(F.col(value).cast("double")), F.lit(0.0)) + F.lit(0.0)  # no negative zero
    seen = settle(df.select(*by, v.alias("v")).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c")), "values")
    sized = (seen.groupBy(*by) if by else seen).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = []
    for name, p in probs.items():
        spot = F.lit(p) * (F.col("n") - 1)
        ends += [F.struct(F.lit(name).alias("name"), F.lit(e).alias("end"), r(spot).cast("long").alias("rank"), (spot - F.floor(spot)).alias("t"))
                 for e, r in (("a", F.floor), ("z", F.ceil))]
    searches = settle(sized.filter("n > 0").select(*by, F.explode(F.array(*ends)).alias("s"), "lo", "hi", F.lit(0).cast("long").alias("below"))
                      .select(*by, "s.*", "lo", "hi", "below"), "searches")
    while not (searching := searches.filter("lo < hi")).isEmpty():
        # At most two brackets per quantile and entity; they don't overlap.
        bracket = F.collect_set(F.struct("lo", "hi", "below")).alias("brackets")
        brackets = (searching.groupBy(*by) if by else searching).agg(bracket)
        inside = (attach(seen, brackets, by).select(*by, "v", "c", F.explode("brackets").alias("b"))
                  .filter((F.col("v") >= F.col("b.lo")) & (F.col("v") <= F.col("b.hi"))).select(*by, "v", "c", "b.*"))
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1)).alias("cell")
        cells = inside.groupBy(*by, "lo", "hi", "below", cell).agg(F.sum("c").alias("n"), F.min("v").alias("vlo"), F.max("v").alias("vhi"))
        order = Window.partitionBy(*by, "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.col("below") + F.sum("n").over(order)  # over the cells of a bracket
        placed = cells.withColumn("upto", upto).select(
            *[F.col(k).alias(f"__{k}") for k in by], F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "vlo", "vhi", "upto", (F.col("upto") - F.col("n")).alias("from"))
        same = (F.col("lo") == F.col("__lo")) & (F.col("hi") == F.col("__hi")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto"))
        for k in by:
            same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        narrowed = searching.join(placed, same).select(*by, "name", "end", "rank", "t", F.col("vlo").alias("lo"), F.col("vhi").alias("hi"), F.col("from").alias("below"))
        searches = settle(searches.filter("lo >= hi").unionByName(narrowed), "searches")

    def found(name: str) -> Column:
        a, z = (F.max(F.when((F.col("name") == name) & (F.col("end") == e), F.col("lo"))) for e in "az")
        return (a + (z - a) * F.max(F.when(F.col("name") == name, F.col("t")))).alias(name)

    return (searches.groupBy(*by) if by else searches).agg(*[found(n) for n in probs])


def impression_quartiles(products: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and third quartile of impressions over products."""
    return exact_quantiles(products, "impressions", {"q1": 0.25, "q3": 0.75}, by)


def _completed(products: DataFrame) -> DataFrame:
    """Add the ratios that a score needs where the table lacks them; null without inputs."""
    def share(num: str, den: str, digits: int, scale: float | None = None) -> Column:
        if {num, den} <= set(products.columns):
            return ratio(F.col(num), F.col(den), digits, scale)
        return F.lit(None).cast("double")

    wanted = {
        "roas": share("ad_sales", "spend", 2),
        "acos_pct": share("spend", "ad_sales", 2, 100.0),
        "cvr_pct": share("ad_orders", "clicks", 2, 100.0),
        "ntb_pct": share("ad_orders_ntb", "ad_orders", 1, 100.0),
    }
    if "impressions" not in products.columns:
        wanted["impressions"] = F.lit(0.0)
    new = {k: c for k, c in wanted.items() if k not in products.columns}
    return products.withColumns(new) if new else products


def asin_health(products: DataFrame, vendor: DataFrame | None = None, by: Sequence[str] = (),
                ordered: bool = True) -> DataFrame:
    """Score from 0 to 100 and tier of each product; vendor revenue and units if given.

    ``products`` is read several times (scores and quartiles): hand over a settled table
    (``sources.stage.settle``) when it is itself an aggregation of a large report.
    """
    df = _completed(products)
    df = attach(df, impression_quartiles(df, by), by)
    zero = F.lit(0.0)
    roas = labels.ladder(F.coalesce("roas", zero), [(6.0, 30), (4.0, 22), (2.0, 12)], 0)
    acos_value = F.coalesce("acos_pct", F.lit(999.0))
    acos = F.when(acos_value < 15, 25).when(acos_value < 25, 18).when(acos_value < 35, 10).otherwise(0)
    cvr = labels.ladder(F.coalesce("cvr_pct", zero), [(15.0, 20), (10.0, 15), (5.0, 8)], 0)
    ntb = labels.ladder(F.coalesce("ntb_pct", zero), [(60.0, 15), (40.0, 10), (20.0, 5)], 0)
    shown = F.coalesce(F.col("impressions"), zero)
    reach = F.when(shown >= F.col("q3"), 10).when(shown >= F.col("q1"), 6).otherwise(2)
    score = (roas + acos + cvr + ntb + reach).cast("double")
    out = df.withColumn("score", score).drop("q1", "q3").withColumn("tier", labels.tier(F.col("score")))
    if vendor is not None:
        out = add_vendor_figures(out, vendor, by)
    return out.orderBy(F.col("score").desc(), F.col("asin")) if ordered else out


def filter_tiers(health: DataFrame, tiers: Sequence[str] = ()) -> DataFrame:
    """Products of the named tiers; no names means all."""
    return health.filter(F.col("tier").isin(*tiers)) if tiers else health


def tier_distribution(health: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count and whole percent of products per tier; empty tiers included."""
    counts = [F.count_if(F.col("tier") == t).alias(t) for t in labels.TIERS]
    wide = (health.groupBy(*by) if by else health).agg(*counts, F.count(F.lit(1)).alias("__all"))
    rows = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).alias("products")) for t in labels.TIERS])
    long = wide.select(*by, "__all", F.explode(rows).alias("r")).select(*by, "__all", "r.*")
    pct = F.coalesce(F.rint(F.try_divide(F.col("products").cast("double"), F.col("__all")) * 100), F.lit(0.0))
    return long.select(*by, "tier", "products", pct.cast("int").alias("pct"))


def score_histogram(health: DataFrame, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Products per score bin; fixed edges from 0 to 100, the last bin closed."""
    score = F.coalesce(F.col("score"), F.lit(0.0))
    bin_no = F.least(F.width_bucket(score, F.lit(0.0), F.lit(100.0), F.lit(bins)), F.lit(bins).cast("long"))
    width = 100.0 / bins
    return (health.groupBy(*by, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("products"))
            .withColumn("bin_start", (F.col("bin") - 1) * F.lit(width)))


def value_histogram(df: DataFrame, value: str, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Rows per bin of a value whose range is open: at most ``bins`` bins of a round width per entity.

    One aggregation finds the range; the width is the smallest of 1, 2 or 5 times a power of ten that covers it, on
    edges that are multiples of the width, with ``bins`` bins at most. Result: bin_start, width, rows. Nulls and what
    is no amount are left out; the last edge is open.
    """
    rows = df.select(*by, finite(F.col(value).cast("double")).alias("v")).filter("v is not null")
    ends = (rows.groupBy(*by) if by else rows).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    least = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.lit(float(bins))).otherwise(F.greatest(F.abs("hi") / 10, F.lit(1.0)))
    power = F.floor(F.log10(least)).cast("int")
    # Powers from a cast are exact, also those below 1; one decade more covers edges that don't fall on the ends.
    steps = F.array(*[F.concat(F.lit(f"{m}e"), (power + e).cast("string")).cast("double") for e in (0, 1) for m in (1, 2, 5)])
    enough = F.filter(steps, lambda w: F.floor(F.col("hi") / w) - F.floor(F.col("lo") / w) + 1 <= bins)
    placed = attach(rows, ends.withColumn("width", enough[0]).select(*by, "width"), by)
    number = F.floor(F.col("v") / F.col("width"))
    return placed.groupBy(*by, "width", number.alias("__bin")).agg(F.count(F.lit(1)).alias("rows")).select(
        *by, (F.col("__bin") * F.col("width")).alias("bin_start"), "width", "rows")
