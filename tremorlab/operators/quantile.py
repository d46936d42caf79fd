"""Exact quantiles of large groups in two passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Half the share of a group that lies between the bounds around a quantile, and the accuracy of the sketch that gives them.
SLACK, ACCURACY = 0.002, 5000
#: Values of a group below which the slack would be too few ranks.
SMALL = 5000


def quantiles(frame: DataFrame, keys: list[str], value: str, qs: list[float], name: str = "q") -> DataFrame:
    """(keys, name): the interpolated quantiles of the non-null values of each group as an array, null for a group without values.

    A sketch that merges gives bounds around each quantile; values below are counted, and only the values between the bounds,
    a few thousandths of a group, combined to counts of distinct ones, are put in order. No task holds a group's values.
    """
    groups = keys or ["_all"]
    x = frame.select(*([F.col(k) for k in keys] or [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_x"))
    ends = [e for q in qs for e in (max(0.0, q - SLACK), min(1.0, q + SLACK))]
    bounds = x.groupBy(*groups).agg(F.count("_x").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.percentile_approx("_x", ends, ACCURACY).alias("_b"))
    # the outermost bounds are the extremes, which a sketch may miss; so are those of small groups, which are put in order whole
    small = F.col("_n") < SMALL
    around = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(q).alias("q"),
            (F.col("_min") if q - SLACK <= 0 else F.when(small, F.col("_min")).otherwise(F.col("_b")[2 * i])).alias("lo"),
            (F.col("_max") if q + SLACK >= 1 else F.when(small, F.col("_max")).otherwise(F.col("_b")[2 * i + 1])).alias("hi"),
        )
        for i, q in enumerate(qs)
    ]
    bounds = bounds.select(*groups, "_n", F.array(*around).alias("_around"))
    known = x.where("_x is not null").join(bounds, groups).select(*groups, "_n", "_x", F.explode("_around").alias("a"))
    # all that lies below the bounds is one row, of value null
    counted = known.where("_x <= a.hi").groupBy(*groups, "_n", "a.i", "a.q", F.when(F.col("_x") >= F.col("a.lo"), F.col("_x")).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*groups, "i").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_upto", F.sum("_c").over(w))
    rank = F.col("q") * (F.col("_n") - 1)
    at = placed.groupBy(*groups, "i").agg(
        F.max(rank).alias("r"),
        F.min(F.when(F.col("_upto") > F.floor(rank), F.col("_x"))).alias("x0"),
        F.min(F.when(F.col("_upto") > F.ceil(rank), F.col("_x"))).alias("x1"),
    )
    value_at = F.when(F.floor("r") == F.ceil("r"), F.col("x0")).otherwise((F.ceil("r") - F.col("r")) * F.col("x0") + (F.col("r") - F.floor("r")) * F.col("x1"))
    found = at.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("i", value_at.alias("v")))).alias("_q"))
    out = bounds.select(*groups).join(found, groups, "left").select(*groups, F.transform("_q", lambda s: s["v"]).alias(name))
    return out if keys else out.drop("_all")
