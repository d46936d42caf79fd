"""Data-quality checks of price panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlab.functions.scalar import business_days
from tremorlab.operators.features import W, with_returns

SPLIT_RATIOS = (2.0, 3.0, 4.0, 5.0, 10.0, 1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 10)


def keep_first(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; ties must agree in all that is used."""
    return frame.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def iqr_outliers(rets: DataFrame, k: float = 5.0) -> DataFrame:
    """Returns strictly outside [Q1 - k IQR, Q3 + k IQR] of their ticker, with interpolated quartiles."""
    q = rets.groupBy("ticker").agg(F.percentile("ret", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    j = rets.join(q, "ticker")
    iqr = F.col("q")[1] - F.col("q")[0]
    return j.where((F.col("ret") < F.col("q")[0] - k * iqr) | (F.col("ret") > F.col("q")[1] + k * iqr)).drop("q")


def stale_runs(panel: DataFrame, least: int = 5) -> DataFrame:
    """Runs of ``least`` or more unchanged days: start_idx, the row that the first of them repeats, last_idx, the row of the
    next change or the series' last, and n, the unchanged days."""
    flat = F.when(F.abs(F.col("price") - F.lag("price").over(W())) < 1e-10, 1).otherwise(0)
    f = panel.withColumn("flat", flat)
    f = f.withColumn("island", F.sum(1 - F.col("flat")).over(W())).withColumn("next_idx", F.lead("idx").over(W()))
    runs = f.groupBy("ticker", "island").agg(F.min("idx").alias("start_idx"), F.max(F.coalesce("next_idx", "idx")).alias("last_idx"), (F.count("*") - 1).alias("n"))
    return runs.where(F.col("n") >= least).drop("island")


def date_gaps(panel: DataFrame, most: int = 5) -> DataFrame:
    """Rows more than ``most`` weekdays after the one before."""
    return panel.withColumn("gap", business_days(F.lag("dt").over(W()), F.col("dt"))).where(F.col("gap") > most)


def split_like(rets: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """Returns within ``tolerance``, relatively, of a usual split ratio."""
    err = F.array_min(F.array(*[F.abs(1 + F.col("ret") - k) / k for k in SPLIT_RATIOS]))
    return rets.withColumn("err", err).where(F.col("err") <= tolerance)


def ohlc_breaks(panel: DataFrame) -> DataFrame:
    """Rows whose high or low contradicts the other prices beyond rounding noise."""
    tol = 1e-10 * F.greatest(F.abs("high"), F.abs("low"), F.abs("price"), F.abs("open"), F.lit(1.0))
    return panel.where((F.col("high") + tol < F.greatest("open", "price", "low")) | (F.col("low") - tol > F.least("open", "price", "high")))


def skew_kurt(frame: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis with the sample deviation inside; null below 4 rows or without spread."""
    m = frame.groupBy(*keys).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    z = (F.col(value) - F.col("m")) / F.col("s")
    s = frame.where(F.col(value).isNotNull()).join(m, keys).groupBy(*keys, "n", "s").agg(F.sum(F.pow(z, 3)).alias("z3"), F.sum(F.pow(z, 4)).alias("z4"))
    n = F.col("n")
    ok = (n >= 4) & (F.col("s") > 0)
    skew = F.when(ok, n / ((n - 1) * (n - 2)) * F.col("z3"))
    kurt = F.when(ok, n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * F.col("z4") - 3 * F.pow(n - 1, 2) / ((n - 2) * (n - 3)))
    return s.select(*keys, skew.alias("skew"), kurt.alias("kurt"))


def report(panel: DataFrame) -> DataFrame:
    """Count of rows by ticker and issue: outliers, stale runs, gaps, split-like moves, bar contradictions."""
    r = with_returns(panel)
    parts = {"outlier": iqr_outliers(r), "stale": stale_runs(panel), "gap": date_gaps(panel), "split_like": split_like(r), "ohlc": ohlc_breaks(panel)}
    out = None
    for name, f in parts.items():
        one = f.groupBy("ticker").agg(F.count("*").alias("n")).select("ticker", F.lit(name).alias("issue"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def assert_strict(panel: DataFrame) -> DataFrame:
    """The panel itself; fails where there is a split-like move or a bar contradiction."""
    bad = report(panel).where(F.col("issue").isin("split_like", "ohlc")).limit(5).collect()
    if bad:
        raise ValueError(f"strict quality failure: {[tuple(b) for b in bad]}")
    return panel
