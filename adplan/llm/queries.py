"""One query per operator over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adplan.llm import bpe, chat, contamination, exactcopies, language, lexical, licenses, nearcopies, quality, repeats, sharding, spelling, warc
from adplan.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op2_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # Nothing is learned from a document without an id, so it is held out.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    model = language.fit(docs.where(~held_out))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op3_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)


def op4_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").cast("string").alias("row"))
    size = F.transform("spans", lambda s: s.end - s.start)
    return repeats.repeated_spans(docs).select(
        F.col("row").cast("long").alias("doc_id"), "n_bytes",
        F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_setsketch_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_components(table(spark, sf_dir, "documents"), 4, 80)


def op8_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest_chats(chat.format_chats(rows.unionByName(probe)))


def op10_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op11_block_maxima_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op12_stateful_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactcopies.exact_copies(spark, f"{sf_dir}/documents.parquet")


def op13_reduced_alphabet_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_transactions, op2_hierarchical_language, op3_weighted_hash_tree, op4_transducer_bpe,
    op5_suffix_repeats, op6_decision_list, op7_setsketch_near_copies,
    op8_benchmark_passages, op9_chat_format, op10_license_notices,
    op11_block_maxima_search, op12_stateful_exact_copies, op13_reduced_alphabet_variants,
)}
