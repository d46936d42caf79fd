"""Connected components of an edge table by alternating star contractions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlab.llm.common import materialize

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: every node hangs on one other at most, and none that hangs carries others."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("carries")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("carries")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("h"), F.max("carries").alias("c")).where("h > 1 or (h = 1 and c = 1)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round a large star hangs a node's larger neighbours onto its smallest one, and a small star
    does so with the smaller neighbours, until only stars around the minima remain. Minima are
    aggregated before they meet the edges, so a hub's edges are never gathered into one row, and the
    join that follows can be split where a hub is hot. Null ends and self loops are ignored; an empty
    table gives an empty result.
    """
    now = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") > F.col("v"))).distinct(),
        "edges",
    )
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
