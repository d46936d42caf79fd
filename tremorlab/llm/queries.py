"""The registered query of each text operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlab.llm.byte_bpe import bpe_digests
from tremorlab.llm.exact_dedup import EXACT_DEDUP_SQL, exact_dedup
from tremorlab.llm import language_id, quality_ranking, toxicity
from tremorlab.llm.line_dedup import dedup_lines
from tremorlab.llm.multiset_fingerprint import fingerprint_with_next
from tremorlab.llm.packing import pack
from tremorlab.llm.secret_scan import scan_secrets
from tremorlab.llm.simhash_vptree import simhash_components


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents."""
    return exact_dedup(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents."""
    docs = _documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash_components(_documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, and their decoding."""
    return bpe_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines: line counts and a digest of the remaining text."""
    out = dedup_lines(_documents(spark, sf_dir), counts=True)
    return out.select("doc_id", "n_lines", "n_kept", F.length("text").cast("long").alias("clean_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = _documents(spark, sf_dir)
    return language_id.predict_languages(docs, language_id.train(docs))


def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    docs = _documents(spark, sf_dir)
    return quality_ranking.score_quality(docs, quality_ranking.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_with_next(_documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, with live-looking ones told from copied examples."""
    return scan_secrets(_documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 ids."""
    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    return {"op1_exact_dedup": op1_exact_dedup, "op2_toxicity": op2_toxicity, "op3_simhash": op3_simhash, "op4_byte_bpe": op4_byte_bpe, "op5_line_dedup": op5_line_dedup, "op6_language_id": op6_language_id, "op7_quality_ranking": op7_quality_ranking, "op8_multiset_fingerprint": op8_multiset_fingerprint, "op9_secret_scan": op9_secret_scan, "op10_packing": op10_packing}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name."""
    return {"op1_exact_dedup": EXACT_DEDUP_SQL}
