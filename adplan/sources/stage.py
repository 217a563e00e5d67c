"""Staged tables: canonical Parquet copies, and intermediate results that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``.

    In local mode, where driver and executors share one machine, a temporary folder
    stands in when the setting is absent.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="adplan-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/adplan-{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled", split: str | None = None) -> DataFrame:
    """Write an intermediate result once and go on from the written table.

    For results that are read several times or are costly to recompute. The copy is
    Parquet in the shared folder, so column pruning still works and a lost executor
    costs no recomputation. ``split`` names a column of few values to make folders of, so
    that reading one value skips the rest.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    (df.write.partitionBy(split) if split else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_stage(df: DataFrame, path: str, date_col: str | None = None, mode: str = "error") -> None:
    """Canonical report as snappy Parquet, in one folder per month when it has a date.

    Mode ``replace`` is for months that are delivered again: the months that df holds replace those of the
    stage, all others stay as they are.

    The rebalance hint gathers the rows of a month and lets adaptive execution split a
    month that holds most of the report, so files come out at the advisory size.
    """
    if date_col is not None:
        df = df.withColumn("month", F.date_trunc("month", F.col(date_col)).cast("date"))
        df = df.hint("rebalance", "month")
    writer = df.write.mode("overwrite" if mode == "replace" else mode).option("compression", "snappy")
    if mode == "replace":
        if date_col is None:
            raise ValueError("only a staged report with months can have months replaced")
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy("month") if date_col is not None else writer).parquet(path)


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    """A staged report; filters on ``month`` skip whole folders."""
    return spark.read.parquet(path)
