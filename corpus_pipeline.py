"""A training corpus from `documents`: quality rules, near copies, repeats, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adplan.llm import bpe, contamination, nearcopies, quality, repeats
from adplan.llm.common import settle, table
from adplan.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rule nor the learned list rejects."""
    docs = docs.select(COLUMNS)
    return quality.quality_verdicts(docs, table(spark, sf_dir, "labels"), extra=tuple(COLUMNS[1:])).where("kept").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) the row with the smallest doc_id; a null one comes last.

    Rows are told apart by a number, not by doc_id: of repeated rows of an id one stays, as of other
    copies, rows of one id with different texts are judged each by its own text, and copies without
    doc_id go like others. Rows without words are copies of nothing and stay.
    """
    numbered = settle(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    near = nearcopies.near_components(numbered.select(F.col("row").alias("doc_id"), "text"), 5, 80)
    placed = settle(near.select(F.col("doc_id").alias("row"), "component_id").join(numbered.select("row", "doc_id"), "row"), "placed")
    first = placed.groupBy("component_id").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).where("n > 1")
    gone = placed.join(first, "component_id").where(F.col("row") != F.col("first.row")).select("row")
    return numbered.join(gone, "row", "left_anti").select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that earlier documents hold; bytes cut inside a character go with it.

    n_chars follows the text. A text that loses everything stays as an empty one.
    """
    row = F.to_json(F.struct("doc_id", "lang", "source", F.col("text").isNull().alias("none")), {"ignoreNullFields": "false"})
    schema = docs.select("doc_id", "lang", "source", F.lit(True).alias("none")).schema
    cut = repeats.repeated_spans(docs.select("doc_id", "text", row.alias("row")), as_text=True)
    return cut.select(F.from_json("row", schema).alias("r"), "kept").select(
        "r.doc_id", F.when(~F.col("r.none"), F.col("kept")).alias("text"), "r.lang", "r.source",
    ).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Texts are told apart by their digest, not by doc_id: a row goes by its own text alone, also where
    its doc_id is null or stands at further rows with other texts. Null texts stay.
    """
    keyed = docs.withColumn("digest", F.sha2("text", 256))
    found = contamination.find_passages(keyed.select(F.col("digest").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = settle(found.select(F.col("doc_id").alias("digest")).distinct(), "contaminated")
    return keyed.join(gone, "digest", "left_anti").select(COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token ids (little-endian 32-bit); decoding gives the text back."""
    coded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", by_quality),
    ("near copies", one_of_each_group),
    ("repeats", without_repeats),
    ("benchmark passages", without_benchmark),
    ("tokens", to_tokens),
]

#: The learned list and the byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
