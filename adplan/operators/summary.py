"""Several groupings of a report from one scan and one shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adplan.functions.numeric import aliased, have, joined, summable
from adplan.functions.schema import FULL_MEASURES

ACCOUNT = "account"
IDLE = "idle_spend"


def summarise(df: DataFrame, dims: Mapping[str, str], by: Sequence[str] = (),
              measures: Sequence[str] = (*FULL_MEASURES, "sales_ntb"), account: bool = True,
              only: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One long table: ``dimension``, the entity, ``key`` and the sums.

    ``dims`` names the dimensions and their columns; with ``account`` there is also a row
    per entity as a whole. ``idle_spend`` is the spend of rows without an order. Partial
    aggregation folds the rows of each grouping set before they move. Dimensions of one
    column are summed once; a dimension that is also an entity column repeats the entity. ``only``
    names the sums that a dimension is wanted with (of those it does not name, all); its others are null and
    move as such.
    """
    folded = [c for c in dict.fromkeys(dims.values()) if c not in by]
    cols = [F.col(c) for c in folded]
    keys = [F.col(c) for c in by]
    whole = account or any(c in by for c in dims.values())
    sets = [[*keys, c] for c in cols] + ([keys] if whole else [])
    idle = {IDLE: ("spend", "coalesce(ad_orders, 0) = 0")} if {"spend", "ad_orders"} <= set(df.columns) else {}
    rows, sums = summable(df, measures, [*by, *folded], idle)
    # Bit i from the right is 1 where column i from the right was folded away.
    every = 2 ** len(cols) - 1
    bits = {c: every ^ (1 << (len(cols) - 1 - i)) for i, c in enumerate(folded)}
    for n in sums if only else ():
        # A grouping of several dimensions carries what any of them is wanted with.
        wanted = {bits.get(c, every) for d, c in dims.items() if n in only.get(d, [n])} | ({every} if account and n in only.get(ACCOUNT, [n]) else set())
        here = f"grouping_id() IN ({', '.join(map(str, sorted(wanted))) or 'NULL'})"
        of, flag = ("spend", f" AND `__f_{n}`") if n in idle else (n, "")
        fields = [c for c in rows.columns if c.rsplit("__", 1)[0] == of]
        sums[n] = F.when(F.expr(here), joined([f"sum(if({here}{flag}, `{c}`, null))" for c in fields]))
    grouped = rows.groupingSets(sets, *keys, *cols).agg(F.grouping_id().alias("__gid"), *aliased(sums))
    labels: dict[int, list] = {}
    for n, c in dims.items():
        labels.setdefault(bits.get(c, every), []).append(F.struct(F.lit(n).alias("dimension"), F.col(c).cast("string").alias("key")))
    if account:
        labels.setdefault(every, []).append(F.struct(F.lit(ACCOUNT).alias("dimension"), F.lit(None).cast("string").alias("key")))
    named = F.explode(F.coalesce(*[F.when(F.col("__gid") == F.lit(b), F.array(*rows)) for b, rows in labels.items()]))
    names = [*have(df, measures), *idle]
    out = grouped.select("*", named.alias("__named")).select("__named.dimension", *by, "__named.key", *names)
    return out.filter(F.col("key").isNotNull() | (F.col("dimension") == ACCOUNT))


def slice_of(summary: DataFrame, dimension: str, key: str | None = None) -> DataFrame:
    """The rows of one dimension, with its key under its own name."""
    rows = summary.filter(F.col("dimension") == dimension).drop("dimension")
    return rows.withColumnRenamed("key", key) if key and key not in rows.columns else rows.drop("key")
