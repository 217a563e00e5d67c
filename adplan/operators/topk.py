"""Ordered heads of a table, per account or per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adplan.functions.numeric import rnd
from adplan.operators.attach import attach


def ranked(metric: str, ties: Sequence[str]) -> list[Column]:
    """Highest metric first, nulls last, ties by key."""
    return [F.col(metric).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]


def top_n(df: DataFrame, metric: str, n: int, ties: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, of the whole table or of each entity.

    Both forms cut to ``n`` rows inside each input partition before anything moves.
    """
    order = ranked(metric, ties)
    if not by:
        return df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def top_n_with_other(df: DataFrame, value: str, metric: str, key: str, n: int = 12,
                     by: Sequence[str] = (), other: str = "Other") -> DataFrame:
    """Positive values of the first ``n`` keys, and one row for what remains of the total."""
    positive = df.filter(F.col(value) > 0).select(*by, key, metric, value)
    head = top_n(positive, metric, n, [key], by).select(*by, F.col(key), F.col(value))

    def summed(frame: DataFrame, name: str) -> DataFrame:
        exact = F.sum(F.col(value).cast("decimal(28,4)")).cast("double").alias(name)
        return (frame.groupBy(*by) if by else frame).agg(exact)

    rest = attach(summed(positive, "whole"), summed(head, "shown"), by)
    rest = (rest.withColumn(value, rnd(F.col("whole") - F.col("shown"), 2))
                .filter(F.col(value) > 0)
                .select(*by, F.lit(other).alias(key), value))
    return head.unionByName(rest)
