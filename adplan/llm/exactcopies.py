"""Exact duplicates on a stream: keyed state on disk without expiry, full bytes compared on hits."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adplan.llm.common import settle, shared_folder

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The state lives in RocksDB on the executors' disks; what a batch changes goes to the checkpoint.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # No space set aside ahead: it is megabytes for every partition of the state, however small.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bits that mark wanted rows before their texts move: 1,024 bitmaps of 4 KB, however many rows there are.
MARKS = 2**25
_ARRIVED = "doc_id long, file string, row long, digest binary, batch long"
_RETAINED = "digest binary, group_size long, keep struct<doc_id:long,file:string,row:long>, first struct<batch:long,file:string,row:long>, last long"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _pattern(path: str) -> str:
    """The path as a pattern: a stream takes a single file only through one."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return path if set(name) & set("*?[{") else f"{parent}/{{{name}}}"


class Deduplicator:
    """Finds equal texts among the Parquet files that arrive below ``source``, with all it remembers in ``folder``.

    ``advance`` takes the files that are new since the last call. A first streaming query notes for
    each row its doc_id, the digest of its normalised text and the content's locator (file and row within
    it). A second one keeps for each digest, in RocksDB and without expiry, how often it came, the
    stable identifier of the row that stays (the largest doc_id; with it that row's locator, as rows
    may repeat an id) and the locator of the first row that came. Its partial aggregation folds the
    copies of a task before anything moves, so a text that makes up a third of all rows is one row a task.
    After each batch, the rows whose digest was there before (hits) and the first row of their digest
    are read by their locators, and their full bytes are compared by grouping on the text itself, again
    folded within each task. Digests found to stand for several texts are noted, and ``result`` tells
    their rows apart by the full texts, so the result doesn't depend on the digest.

    Only digests, identifiers and locators are stored; texts are read where they lie, so files must stay
    and must not change. Either query resumes from its own checkpoint, and a batch that is repeated
    after a failure overwrites its own folder.
    """

    def __init__(self, spark: SparkSession, source: str, folder: str | None = None, digest=sha256, files_per_trigger: int = 10_000):
        self.spark, self.source, self.digest, self.files = spark, source, digest, files_per_trigger
        self.folder = folder or shared_folder(spark, "exact-copies")
        self.schema = spark.read.parquet(source).schema

    def _located(self, rows: DataFrame) -> DataFrame:
        at = rows.metadataColumn("_metadata")
        return rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["text"], at["file_path"].alias("file"), at["row_index"].alias("row"))

    def _written(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/*")

    def _run(self, name: str, stream: DataFrame, mode: str, each) -> None:
        query = (stream.writeStream.outputMode(mode).foreachBatch(each).trigger(availableNow=True)
                 .option("checkpointLocation", f"{self.folder}/checkpoint-{name}").start())
        query.awaitTermination()

    def advance(self) -> Deduplicator:
        """Take in all files that came since the last call."""
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(_pattern(self.source))
        arriving = self._located(rows).select("doc_id", "file", "row", self.digest(normalised(F.col("text"))).alias("digest"))

        def note(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/arrived/{number}")

        self._run("arrivals", arriving, "append", note)
        arrived = self.spark.readStream.schema(_ARRIVED).parquet(f"{self.folder}/arrived/*")
        retained = arrived.groupBy("digest").agg(
            F.count("*").alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("keep"),
            F.min(F.struct("batch", "file", "row")).alias("first"), F.max("batch").alias("last"))
        with _settings(self.spark, _STATE):
            self._run("state", retained, "update", self._check)
        return self

    def _check(self, changed: DataFrame, number: int) -> None:
        """Write what the state of a batch's digests is now, and which of them stand for several texts."""
        changed.write.mode("overwrite").parquet(f"{self.folder}/retained/{number}")
        now = self.spark.read.schema(_RETAINED).parquet(f"{self.folder}/retained/{number}")
        done = -1
        if number:
            earlier = [f"{self.folder}/retained/{n}" for n in range(number)]
            done = self.spark.read.schema(_RETAINED).parquet(*earlier).agg(F.max("last")).first()[0]
        hits = now.where("group_size > 1").select("digest", "first")
        fresh = self._written("arrived", _ARRIVED).where(F.col("batch") > F.lit(-1 if done is None else done))
        rows = fresh.join(hits, "digest", "left_semi").select("digest", "file", "row").union(
            hits.select("digest", "first.file", "first.row")).distinct()
        mixed = self._texts(rows).groupBy("digest", "text").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts"))
        mixed.where("texts > 1").select("digest").write.mode("overwrite").parquet(f"{self.folder}/mixed/{number}")

    def _texts(self, rows: DataFrame) -> DataFrame:
        """The rows (file, row, anything else) with their normalised texts, read where they lie.

        Bitmaps of the wanted rows' hashes keep most other texts from moving; what their chance agreement
        lets through, the join takes out.
        """
        bit = F.pmod(F.xxhash64("file", "row"), F.lit(MARKS))
        marks = rows.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("marks"))
        contents = self._located(self.spark.read.schema(self.schema).parquet(self.source)).drop("doc_id")
        placed = contents.withColumns({"bucket": F.bitmap_bucket_number(bit), "place": F.bitmap_bit_position(bit)})
        byte = F.conv(F.hex(F.substring("marks", F.expr("cast(place div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
        marked = placed.join(F.broadcast(marks), "bucket").where(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1)
        return marked.select("file", "row", "text").join(rows, ["file", "row"]).withColumn("text", normalised(F.col("text")))

    def result(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256, one per row that arrived.

        Of equal texts the row with the largest doc_id stays; of rows that repeat it, one. A null doc_id is
        smaller than any other.
        """
        arrived = self._written("arrived", _ARRIVED) if self._any("arrived") else self.spark.createDataFrame([], _ARRIVED)
        retained = self._written("retained", _RETAINED) if self._any("arrived") else self.spark.createDataFrame([], _RETAINED)
        # The count of a digest only grows: the largest is the latest.
        latest = retained.groupBy("digest").agg(F.max(F.struct("group_size", "keep")).alias("s")).select("digest", "s.group_size", "s.keep")
        latest = settle(latest, "latest")  # so that adaptive execution can split a digest that many rows share
        told = arrived.join(latest, "digest")
        if self._any("arrived"):
            mixed = self._written("mixed", "digest binary").distinct()
            if not mixed.isEmpty():
                apart = self._texts(arrived.join(mixed, "digest", "left_semi"))
                groups = apart.groupBy("text").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
                told = told.join(mixed, "digest", "left_anti").unionByName(apart.join(groups, "text").drop("text"))
        exact = self.digest is sha256
        out = told if exact else self._texts(told).withColumn("digest", sha256(F.col("text")))
        same = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
        return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", same.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def _any(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)


def exact_copies(spark: SparkSession, source: str, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of the Parquet files of ``source`` (doc_id integer, text).

    Texts are equal when they are identical after lower-casing A-Z alone; null counts as empty. Extra
    columns are ignored; an empty table gives no rows.
    """
    return Deduplicator(spark, source, folder).advance().result()
