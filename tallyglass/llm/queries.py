"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .decontaminate import decontaminate
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .oracle import SQL
from .quality import classify
from .quality_rules import quality_rules
from .records import encode_to_records
from .sharding import shard_documents
from .token_counts import token_counts
from .trie_bpe import round_trip_digests


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", F.array_join("failed_rules", ",").alias("failed_rules"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_words_removed", "n_words_left")


def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_to_records(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_winnowing_decontamination": op3_winnowing_decontamination,
    "op4_minimax_sharding": op4_minimax_sharding,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_binary_records": op8_binary_records,
    "op9_token_counts": op9_token_counts,
    "op10_trie_bpe": op10_trie_bpe,
}

ORACLE_SQL = SQL
