"""Sets of tables that readers see whole: versioned folders and a manifest that moves last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "_current.json"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there in one step."""
    jvm, (fs, target) = spark._jvm, _fs(spark, path)
    _, beside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, target, options)


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What readers see: version, and per table its schema, rows and digest; None before the first version."""
    fs, path = _fs(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def summary_of(df: DataFrame) -> tuple[int, int]:
    """Rows, and a digest of all values that does not depend on the order of rows."""
    # Sums of hashes wrap nowhere: each is cut to 31 bits, and the total is a decimal.
    each = F.pmod(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if k.startswith("map") else F.col(f"`{c}`") for c, k in df.dtypes]), F.lit(2**31))
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(each.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))).first()
    return int(row[0]), int(row[1])


def publish(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], version: str | None = None, keep: int = 2,
            fmt: str = "parquet") -> dict:
    """Write a set of tables as one version and let readers see it, all of it or nothing.

    Every table goes to a folder of the version and is read back for its rows and digest; then the
    manifest moves to the new version. A failure before that leaves the earlier version in place. A version
    that readers see already is not written again. Of older versions the last ``keep - 1`` stay for readers
    that are still at work.
    """
    folder, before = folder.rstrip("/"), manifest(spark, folder)
    version = version or uuid.uuid4().hex
    if before and before["version"] == version:
        return before
    place, entries = f"{version}-{uuid.uuid4().hex[:8]}", {}
    for name, df in tables.items():
        path = f"{folder}/{place}/{name}"
        writer = df.write.format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(path)
        back = spark.read.format(fmt).schema(df.schema)
        rows, digest = summary_of((back.option("header", True) if fmt == "csv" else back).load(path))
        entries[name] = {"path": path, "schema": df.schema.json(), "rows": rows, "digest": digest}
    history = [place, *(before or {}).get("history", [])]
    now = {"version": version, "format": fmt, "tables": entries, "history": history[:keep]}
    _put(spark, f"{folder}/{MANIFEST}", json.dumps(now))
    for old in history[keep:]:
        fs, path = _fs(spark, f"{folder}/{old}")
        fs.delete(path, True)
    return now


def read_version(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the version that is current; none before the first."""
    now = manifest(spark, folder)
    if now is None:
        return {}
    read = spark.read.format(now["format"])
    return {n: (read.option("header", True) if now["format"] == "csv" else read).schema(StructType.fromJson(json.loads(t["schema"]))).load(t["path"])
            for n, t in now["tables"].items()}
