"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abyssal.llm import bm25, byte_bpe, centroids, divergence, fingerprints, jaccard_join, line_dedup, mixing, passages, quality, sharding, toxicity, url_filter
from abyssal.llm.common import read

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op2_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.where(F.col("doc_id") % 50 == 0), k=10)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).select("page_id", "host", "path", "rule", "verdict")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignment(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.col("n_lines").cast("int").alias("n_lines"), F.col("n_removed").cast("int").alias("n_removed"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.successions(read(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_byte_bpe, op2_bm25, op3_ngram_jaccard, op4_mixing, op5_substring_dedup, op6_url_filter, op7_sharding, op8_line_dedup, op9_quality, op10_fingerprints, op11_toxicity, op12_divergence, op13_centroids]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.ORACLE, "op6_url_filter": url_filter.ORACLE, "op7_sharding": sharding.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op12_divergence": divergence.ORACLE, "op13_centroids": centroids.ORACLE}
