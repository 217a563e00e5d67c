"""Streams against the same computation in batch."""

import json

import pytest
from pyspark.sql import functions as F

from adplan import fixtures
from adplan.operators.timeseries import trend
from adplan.sources import stage, versions
from adplan.sources.tables import table
from adplan.streaming import live

SMALL = "/root/testdata/sf0.001"


def stream_of(spark):
    schema = table(spark, SMALL, "events").schema
    return fixtures.event_measures(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SMALL))


def test_closed_weeks_of_an_appending_stream(spark, tmp_path):
    path = str(tmp_path / "weeks")
    live.run_available(live.stream_trend(stream_of(spark), "W", delay="0 seconds"), path, "append", str(tmp_path / "progress"))
    got = {tuple(r) for r in spark.read.parquet(path).drop("batch_id").collect()}
    events = fixtures.event_measures(table(spark, SMALL, "events"))
    batch = trend(events.withColumn("report_date", F.to_date("ts")), "W")
    want = {tuple(r) for r in batch.collect()}
    latest = events.agg(F.max("ts")).first()[0].date()
    closed = {r for r in want if (latest - r[0]).days >= 7}
    assert closed and closed <= got <= want


def test_a_restarted_stream_takes_only_new_files(spark, tmp_path):
    folder, target, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    rows = spark.createDataFrame([("a", "$1.50"), ("b", "--")], "`Campaign name` string, `Spend` string")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").option("header", True).csv(folder)
        stream = live.read_report_stream(spark, folder, rows.columns)
        query = live.run_available(live.stream_kpis(stream, ["campaign_name"]), target, "complete", progress)
        assert query.recentProgress[0]["numInputRows"] == 2
    got = {r.campaign_name: r.total_spend for r in spark.read.parquet(target).collect()}
    assert got == {"a": 3.0, "b": 0.0}


def test_closed_months_of_a_stream(spark, tmp_path):
    events = fixtures.event_measures(table(spark, SMALL, "events"))
    later = lambda df: df.withColumn("ts", F.col("ts") + F.make_ym_interval(F.lit(0), (F.col("event_id") % 3).cast("int")))
    got = {tuple(r) for r in live.run_months(later(stream_of(spark)), str(tmp_path / "months"), delay="0 seconds").collect()}
    whole = {tuple(r) for r in trend(later(events).withColumn("report_date", F.to_date("ts")), "M").collect()}
    assert len(whole) == 3 and got == {r for r in whole if r[0] < max(w[0] for w in whole)}
    days = spark.read.parquet(str(tmp_path / "months" / "days"))
    assert live.months_of(days.drop("batch_id"), closed=False).count() == 3


def kpi_stream(spark, folder):
    return live.stream_kpis(live.read_report_stream(spark, folder, ["Campaign name", "Spend"]), ["campaign_name"])


def result(spark, path):
    return {r.campaign_name: r.total_spend for r in live.current(spark, path).collect()}


def test_a_current_table_is_never_seen_half_written(spark, tmp_path, monkeypatch):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "$1.50"), ("b", "2"), (None, "1")], "`Campaign name` string, `Spend` string")
    rows.coalesce(1).write.option("header", True).csv(folder)
    live.keep_current(kpi_stream(spark, folder), path, ["campaign_name"])
    first = result(spark, path)
    assert first == {"a": 1.5, "b": 2.0, None: 1.0}
    # While the next batch has written its table but not moved the manifest, readers find the first one.
    seen, put = [], versions._put

    def late(*args):
        seen.append(result(spark, path))
        raise RuntimeError("lost")

    rows.filter("`Campaign name` = 'a'").coalesce(1).write.mode("append").option("header", True).csv(folder)
    monkeypatch.setattr(versions, "_put", late)
    with pytest.raises(Exception, match="lost"):
        live.keep_current(kpi_stream(spark, folder), path, ["campaign_name"])
    assert seen == [first] and result(spark, path) == first
    # The batch that was lost is done again, once.
    monkeypatch.setattr(versions, "_put", put)
    live.keep_current(kpi_stream(spark, folder), path, ["campaign_name"])
    assert result(spark, path) == {"a": 3.0, "b": 2.0, None: 1.0}
    before = versions.manifest(spark, path)
    live.keep_current(kpi_stream(spark, folder), path, ["campaign_name"])
    assert versions.manifest(spark, path) == before
    assert versions.publish(spark, path, {"result": rows}, before["version"]) == before


def test_a_failing_table_leaves_the_earlier_set(spark, tmp_path):
    folder = str(tmp_path / "plan")
    good = {"a": spark.range(5).toDF("x"), "b": spark.createDataFrame([("q", 1.5), (None, None)], "s string, v double")}
    assert versions.read_version(spark, folder) == {}
    entry = versions.publish(spark, folder, good)["tables"]
    assert (entry["a"]["rows"], entry["b"]["rows"]) == (5, 2) and entry["a"]["digest"] != entry["b"]["digest"]
    bad = {"a": spark.range(7).toDF("x"), "b": spark.range(3).select(F.raise_error(F.lit("broken")).cast("string").alias("s"))}
    with pytest.raises(Exception, match="broken"):
        versions.publish(spark, folder, bad)
    assert {n: df.count() for n, df in versions.read_version(spark, folder).items()} == {"a": 5, "b": 2}
    # Any order of rows and files gives the same digest; another value does not.
    assert versions.summary_of(good["a"].repartition(3).orderBy(F.desc("x"))) == (5, entry["a"]["digest"])
    assert versions.summary_of(good["a"].withColumn("x", F.col("x") + F.when(F.col("x") == 4, 1).otherwise(0)))[1] != entry["a"]["digest"]
    for _ in range(3):
        versions.publish(spark, folder, good)
    assert len(json.loads((tmp_path / "plan" / versions.MANIFEST).read_text())["history"]) == 2
    assert len([p for p in (tmp_path / "plan").iterdir() if p.is_dir()]) <= 3


def test_a_month_delivered_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "stage")
    rows = spark.createDataFrame([("2025-01-05", 1.0), ("2025-01-20", 2.0), ("2025-02-05", 4.0)], "d string, spend double").withColumn("d", F.to_date("d"))
    stage.save_stage(rows, path, "d")
    stage.save_stage(rows.filter("month(d) = 1").limit(1).withColumn("spend", F.lit(9.0)), path, "d", "replace")
    assert sorted((str(r.d), r.spend) for r in stage.load_stage(spark, path).collect()) == [("2025-01-05", 9.0), ("2025-02-05", 4.0)]
    with pytest.raises(ValueError):
        stage.save_stage(rows, path, None, "replace")
