"""What probabilities are worth: exposure management, hedging, equity curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def equity_curve(frame: DataFrame, ret: str = "ret") -> DataFrame:
    """Compounded growth of one unit."""
    w = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce(ret, F.lit(0.0)))).over(w)))


def carried(frame: DataFrame) -> DataFrame:
    """p_carried: the last known probability at each day."""
    w = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn("p_carried", F.last("p", ignorenulls=True).over(w))


def managed(frame: DataFrame, threshold: float = 0.2, cost_bps: float = 5.0) -> DataFrame:
    """Half weight where the carried probability reaches the threshold, with a cost on changes of weight.

    Yesterday's weight follows its own probability; where it had none, today's carried one stands in and no cost arises.
    """
    w = Window.partitionBy("ticker").orderBy("idx")
    half = lambda p: F.when(p >= threshold, 0.5).otherwise(1.0)
    f = carried(frame).withColumn("weight", half(F.coalesce("p_carried", F.lit(0.0))))
    prev = half(F.coalesce(F.lag("p").over(w), F.col("p_carried"), F.lit(0.0)))
    f = f.withColumn("cost", F.abs(F.col("weight") - prev) * cost_bps / 1e4)
    return f.withColumn("net", F.col("weight") * F.col("ret") - F.col("cost"))


def performance(frame: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """Annualised mean, deviation and Sharpe ratio (at least 20 rows), and the mean of the worst twentieth."""
    f = frame.where(F.col(ret).isNotNull())
    cut = f.groupBy(*keys).agg(F.percentile(ret, F.lit(0.05)).alias("_c"))
    g = f.join(cut, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(ret).alias("m"), F.stddev_pop(ret).alias("s"), (-F.avg(F.when(F.col(ret) <= F.col("_c"), F.col(ret)))).alias("cvar"))
    return g.select(*keys, "n", (F.col("m") * 252).alias("annual"), (F.col("s") * 252**0.5).alias("vol"), F.when((F.col("n") >= 20) & (F.col("s") > 0), F.col("m") / F.col("s") * 252**0.5).alias("sharpe"), "cvar")


def hedging(frame: DataFrame, threshold: float, premium: float = 0.002) -> DataFrame:
    """Returns without a hedge, always hedged and hedged where p reaches the threshold; a hedge floors the loss at tau for a premium."""
    hedged = F.greatest(F.col("ret_h"), -F.col("tau")) - premium
    return frame.withColumn("unhedged", F.col("ret_h")).withColumn("always", hedged).withColumn("selective", F.when(F.col("p") >= threshold, hedged).otherwise(F.col("ret_h")))
