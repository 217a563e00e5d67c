"""Structured Streaming forms of reading, trends and KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from adplan.functions.dates import period_start
from adplan.functions.numeric import totals
from adplan.functions.schema import CORE_MEASURES
from adplan.operators.attach import attach
from adplan.operators.ingest import parse_ads, parse_vendor
from adplan.operators.kpis import ads_kpis
from adplan.operators.ratios import add_ctr, add_ratios
from adplan.sources.stage import new_folder
from adplan.sources.versions import manifest, publish, read_version

DAYS = "days"
WINDOWS = {"M": ("1 day", "0 seconds"), "D": ("1 day", "0 seconds"), "W": ("7 days", "4 days")}  # weeks start on Monday


def text_schema(headers: Sequence[str]) -> StructType:
    return StructType([StructField(h, StringType()) for h in headers])


def read_report_stream(spark: SparkSession, folder: str, headers: Sequence[str], kind: str = "ads",
                       files_per_trigger: int | None = None, encoding: str = "UTF-8") -> DataFrame:
    """New report files of a folder as a typed stream. Progress: ``query.recentProgress``.

    A file whose headers are others, or in another order, fails the query.
    """
    reader = (spark.readStream.schema(text_schema(headers)).option("header", True)
              .option("encoding", encoding).option("quote", '"').option("escape", '"')
              .option("enforceSchema", False))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.csv(folder)
    return parse_ads(raw, infer=False) if kind == "ads" else parse_vendor(raw, infer=False)


def _windowed(stream: DataFrame, freq: str, ts: str, delay: str, by: Sequence[str]) -> DataFrame:
    length, start = WINDOWS[freq]
    window = F.window("__ts", length, startTime=start)
    summed = (stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
              .groupBy(window.alias("w"), *by).agg(*totals(stream, CORE_MEASURES)))
    measures = [c for c in summed.columns if c not in ("w", *by)]
    return summed.select(*by, F.col("w.start").cast("date").alias("period_start"), *measures)


def stream_trend(stream: DataFrame, freq: str = "W", ts: str = "ts", delay: str = "1 day",
                 by: Sequence[str] = ()) -> DataFrame:
    """Measures per day or week; in append mode, state of a period is dropped once the watermark passes it.

    Months have no fixed length, so no window: with ``M`` the stream gives the sums of single days, without
    ratios. Append them (`run_available`) and fold them with `months_of`.
    """
    flat = _windowed(stream, freq, ts, delay, by)
    return flat if freq == "M" else add_ctr(add_ratios(flat)).drop("cvr_pct")


def months_of(days: DataFrame, by: Sequence[str] = (), closed: bool = True) -> DataFrame:
    """Months with their ratios from the appended sums of days.

    A month is closed when a later day is: the watermark has passed all of its days then, and no row can
    change it. ``closed`` leaves the others out.
    """
    month = period_start(F.col("period_start"), "M")
    out = days.groupBy(*by, month.alias("period_start")).agg(*totals(days, CORE_MEASURES, wide=True))
    if closed:
        latest = days.agg(F.max("period_start").alias("latest"))
        out = attach(out, latest).filter(period_start(F.date_add("latest", 1), "M") > F.col("period_start")).drop("latest")
    return add_ctr(add_ratios(out)).drop("cvr_pct")


def run_months(stream: DataFrame, folder: str, ts: str = "ts", delay: str = "1 day", by: Sequence[str] = ()) -> DataFrame:
    """Take what is available now, append the days that closed to ``folder`` and return the closed months.

    State holds the open days alone. A batch that is repeated overwrites its own days.
    """
    run_available(stream_trend(stream, "M", ts, delay, by), f"{folder}/{DAYS}", "append", f"{folder}/progress")
    return months_of(stream.sparkSession.read.parquet(f"{folder}/{DAYS}").drop("batch_id"), by)


def stream_kpis(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running KPIs; use output mode update (`keep_current`) or complete."""
    return ads_kpis(stream, by)


def run_available(df: DataFrame, path: str, mode: str = "complete", progress: str | None = None) -> StreamingQuery:
    """Process everything that is available now and keep the result table at ``path``.

    Complete results replace the table in each batch; appended ones go to a folder per
    batch, so that a batch repeated after a failure overwrites itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        target = path if mode == "complete" else f"{path}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    spark = df.sparkSession
    query = (df.writeStream.foreachBatch(write).outputMode(mode)
             .option("checkpointLocation", progress or new_folder(spark, "progress"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def keep_current(df: DataFrame, folder: str, keys: Sequence[str], progress: str | None = None) -> StreamingQuery:
    """Process everything that is available now and keep a result table by key up to date, in update mode.

    Each batch writes a version of the whole table (rows of keys that changed replace the earlier ones) and
    moves the manifest last, so readers (`current`) see the table before the batch or after it, never part of it. A
    batch that is repeated after a failure finds its version and changes nothing. ``progress`` is part of the table
    unless given: a table goes on with the progress that made it.
    """
    spark, folder = df.sparkSession, folder.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        last = manifest(spark, folder)
        if last is not None and int(last["version"]) >= batch_id:
            return
        before = read_version(spark, folder).get("result")
        if before is None:
            after = batch
        elif not keys:
            after = batch if not batch.isEmpty() else before
        else:
            same = [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
            kept = before.alias("b").join(batch.select(*keys).alias("n"), same, "left_anti")
            after = kept.unionByName(batch)
        publish(spark, folder, {"result": after}, str(batch_id))

    query = (df.writeStream.foreachBatch(write).outputMode("update")
             .option("checkpointLocation", progress or f"{folder}/_progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The result table as the last whole batch left it."""
    return read_version(spark, folder)["result"]
