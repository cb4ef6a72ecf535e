"""From raw documents to token ids: classify, cut copied passages, drop near copies, decontaminate, encode.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame; all but the
last return the columns of documents. Between stages the rows are written as Parquet and read again, so a lost executor
costs one stage's tasks at most.

Results for odd input: stages follow the docstrings of their operators; the classifier and decontamination judge each row
by its own text, whatever its id; near copies go by id, so rows that repeat an id stay or go together there, and rows
without an id are never near copies; other columns than those of documents are carried along; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import free, fresh_path, keep, read, small
from tallyglass.llm.decontaminate import decontaminate
from tallyglass.llm.line_dedup import dedup_lines
from tallyglass.llm.minhash import near_duplicates
from tallyglass.llm.quality import classify
from tallyglass.llm.trie_bpe import encode_texts


def _drop(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that gone names by doc_id and, where it has that column, by text_hash; a null id is an id like others."""
    by_text = "text_hash" in gone.columns
    of, named = free("gone_id", docs.columns), free("gone_text", docs.columns)
    gone = small(keep(gone.select(F.col("doc_id").alias(of), *([F.col("text_hash").alias(named)] if by_text else [])).distinct()))
    same = F.col("doc_id").eqNullSafe(F.col(of))
    return docs.join(gone, same & (F.xxhash64("text") == F.col(named)) if by_text else same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls low or toxic."""
    return _drop(docs, classify(docs, read(spark, sf_dir, "labels")).filter("not kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has; drops documents of which nothing is left."""
    out = dedup_lines(docs, min_words=50).filter("n_words_removed = 0 or n_words_left > 0")
    return out.withColumn("n_chars", F.when(F.col("n_words_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies: sets of 5-word shingles, similarity 0.8 or more."""
    return _drop(docs, near_duplicates(docs, shingle=5, percent=80).filter("not kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more stand in benchmark windows."""
    return _drop(docs, decontaminate(docs, read(spark, sf_dir, "benchmark")).filter("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document."""
    out = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("minhash near-dedup", near_copies), ("benchmark decontamination", decontaminated), ("BPE encoding", encoded)]

#: SQL can't express the classifier, the alignment or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
