"""A corpus pipeline over ``documents``: each stage calls one text operator and works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlab.llm import language_id
from tremorlab.llm.common import Scratch, materialize
from tremorlab.llm.line_dedup import dedup_lines
from tremorlab.llm.packing import pack
from tremorlab.llm.secret_scan import redact
from tremorlab.llm.simhash_vptree import drop_near_duplicates
from tremorlab.session import reachable


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date with the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: null texts, texts without a letter and those the trained model rejects.

    Short and mixed texts stay, and all documents where no language was learned.
    """
    return language_id.keep_identified(docs, language_id.train(docs), least=None)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and fuzzily repeated lines go; every document stays, perhaps with an empty text."""
    return _sized(dedup_lines(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document of the smallest id stays; without an id, the one of the smallest hash of its text.

    Rows that share id and text are one document, of which one row stays. Different texts under one id, or
    under none, are documents of their own and stay unless their component has another.
    """
    return drop_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced by a mark; every document stays."""
    return _sized(redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("simhash_near_dedup", near_duplicate_stage), ("secret_scan", secret_stage), ("packing", packing_stage)]

#: SQL cannot express SimHash trees or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; a stage's input goes once its output is written."""
    docs = reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            out = scratch.table(stage(spark, docs, sf_dir), name)
            scratch.drop(*[docs] if docs is not None and hasattr(docs, "_tremor_path") else [])
            docs = out
        return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
