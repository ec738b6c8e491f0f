"""Queries opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ann, centroids, chat_format, decontaminate, hard_negatives, jaccard_join, language_id, line_dedup, packing, quality, secrets, sharding, token_counts
from textloom.shipping import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine (the same on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=8)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, sf_dir, "documents")).drop("span_list")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"), size=5, percent=80)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.train(docs))
    return out.withColumn("held_out", quality.held_out(F.col("doc_id"), 4, 2))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("i") % 100 == 0, positives=5, negatives=5, low=80, scale=256, label=hard_negatives.shifted_label())


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(chat_format.PLANTED, "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(said.unionByName(planted)))


QUERIES = {f.__name__: f for f in (op1_ann, op2_quality, op3_line_dedup, op4_sharding, op5_token_counts, op6_secrets, op7_packing, op8_decontaminate, op9_jaccard_join, op10_language_id, op11_centroids, op12_hard_negatives, op13_chat_format)}
ORACLES = {"op11_centroids": centroids.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_chat_format": chat_format.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op8_decontaminate": decontaminate.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE}
