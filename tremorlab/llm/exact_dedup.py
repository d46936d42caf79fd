"""Exact duplicates with a heavy-hitter split.

A Misra-Gries style frequent-items summary (Spark's ``approx_top_k`` family, which merges) finds
digests that may be frequent. Their exact counts are verified; verified winners are provably at
most ``tracked`` rows, are broadcast, and their documents are decided on the map side. All other
digests go through one ordinary shuffle, where no group can exceed 1/``tracked`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlab.llm.common import materialize, text_or_empty

#: A digest with more than rows/TRACKED copies is always found.
TRACKED = 4096
#: Items that the summary tracks for each of these. Its error is at most 3.5 / map size of the rows, the map size the power of two at
#: or above 4/3 of its items: 3 * 4096 items give 16384, and so an error below 1/4681 of the rows.
ITEMS = 3
#: Summaries are merged in this many groups first, so that no task receives one from every partition.
MERGE_GROUPS = 256


def frequent_digests(digests: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """Verified frequent digests: (digest, keep_id, group_size) with group_size > rows/tracked."""
    key = digests.select(F.xxhash64("digest").alias("k"), (F.spark_partition_id() % MERGE_GROUPS).alias("g"))
    partial = key.groupBy("g").agg(F.expr(f"approx_top_k_accumulate(k, {ITEMS * tracked})").alias("s"), F.count("*").alias("n"))
    # grouped by a column that is always 0: a global aggregate would also merge the typeless summaries of empty partitions
    merged = partial.groupBy((F.col("g") % 1).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {ITEMS * tracked})").alias("s"), F.sum("n").alias("n"))
    found = merged.select(F.expr(f"approx_top_k_estimate(s, {ITEMS * tracked})").alias("top"), "n").select(F.explode("top").alias("t"), "n")
    # an estimate never falls short of the true count, so this drops no frequent digest and leaves a bounded list
    candidates = found.where(F.col("t.count") * tracked > F.col("n")).select(F.col("t.item").alias("k"), "n")
    exact = (
        digests.withColumn("k", F.xxhash64("digest"))
        .join(F.broadcast(candidates), "k")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max("n").alias("n"))
    )
    return exact.where(F.col("group_size") * tracked > F.col("n")).select("digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty; the largest id of equal texts stays.
    Rows that repeat an id together with its text share one ``kept``. A null id never wins
    unless all ids of its group are null. Other columns of the input are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)).alias("digest"))
    digests = materialize(rows, "digests")
    winners = materialize(frequent_digests(digests, tracked), "winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    tail = (
        digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("keep_id", F.max("doc_id").over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return heavy.unionByName(tail).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
