"""Baseline probabilities that a move of tau or more happens within a horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlab.functions.scalar import norm_cdf
from tremorlab.operators.lookup import as_of


def with_iv(frame: DataFrame, iv: DataFrame) -> DataFrame:
    """iv: the latest known 30-day implied volatility at each date; rows before the first are dropped."""
    known = iv.where("iv_30d is not null").select("dt", "iv_30d")
    return as_of(frame, known).withColumn("iv", F.col("found")["iv_30d"]).drop("found").where("iv is not null")


def clipped(frame: DataFrame, p: F.Column) -> DataFrame:
    return frame.withColumn("p", F.greatest(F.lit(0.001), F.least(F.lit(0.999), p)))


def market_implied(frame: DataFrame) -> DataFrame:
    """Two-sided log-normal probability with the -sigma^2/2 drift."""
    s = F.col("iv") * F.sqrt(F.col("horizon") / 252.0)
    down, up = (F.log(1 - F.col("tau")) + 0.5 * s * s) / s, (F.log(1 + F.col("tau")) + 0.5 * s * s) / s
    return clipped(frame, norm_cdf(down) + 1 - norm_cdf(up))


def implied_vol(frame: DataFrame) -> DataFrame:
    """2 (1 - Phi(tau / sigma_h)), within 0 and 1."""
    s = F.col("iv") * F.sqrt(F.col("horizon") / 252.0)
    return frame.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - norm_cdf(F.col("tau") / s)))))


def vol_rule(frame: DataFrame, level: str, q: float = 0.8, mult: float = 1.5) -> DataFrame:
    """Base rate raised where the level exceeds its rolling quantile and lowered elsewhere; the base rate itself below 63 values."""
    w = Window.partitionBy("ticker", "horizon").orderBy("dt").rowsBetween(-251, 0)
    f = frame.withColumn("_q", F.percentile(level, F.lit(q)).over(w)).withColumn("_n", F.count(level).over(w))
    base = F.col("base")
    p = F.when(F.col("_n") < 63, base).when(F.col(level) > F.col("_q"), F.least(base * mult, F.lit(0.95))).otherwise(F.greatest(base / mult, F.lit(0.005)))
    return clipped(f, p).drop("_q", "_n")
