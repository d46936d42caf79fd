"""Forecast scores over (p, y) tables, by group. Rows without p or y are left out first; groups of one class give null where a score needs both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of quantile forecasts.
LEVELS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def valid(frame: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Rows with a finite p and y."""
    return frame.where(F.col(p).isNotNull() & F.col(y).isNotNull() & ~F.isnan(p) & ~F.isnan(y))


def log_loss_term(p: Column, y: Column) -> Column:
    c = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    return -(y * F.log(c) + (1 - y) * F.log(1 - c))


def basic(frame: DataFrame, keys: list[str]) -> DataFrame:
    """n, event rate, Brier, log loss, separation and Brier skill in one pass."""
    f = valid(frame)
    brier, rate = F.avg(F.pow(F.col("p") - F.col("y"), 2)), F.avg("y")
    ref = rate * (1 - rate)
    sep = F.avg(F.when(F.col("y") == 1, F.col("p"))) - F.avg(F.when(F.col("y") == 0, F.col("p")))
    return f.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rate.alias("rate"),
        brier.alias("brier"),
        F.avg(log_loss_term(F.col("p"), F.col("y"))).alias("log_loss"),
        sep.alias("separation"),
        F.when(ref >= 1e-15, 1 - brier / ref).alias("bss"),
    )


def auc(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the curve with mid-ranks for ties; null with one class.

    Equal probabilities are first counted together, so the ranking window sees a row per distinct value.
    """
    f = valid(frame).groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    g = f.withColumn("won", F.col("pos") * (F.coalesce(below, F.lit(0.0)) + F.col("neg") / 2))
    s = g.groupBy(*keys).agg(F.sum("won").alias("w"), F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    return s.select(*keys, F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("w") / (F.col("a") * F.col("b"))).alias("auc"))


def ece_bins(frame: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Equal-width bins: n, mean p, mean y, gap; the last bin is closed."""
    k = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    g = valid(frame).withColumn("bin", k).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))
    return g.withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))


def _weighted_gap(bins: DataFrame, keys: list[str], name: str) -> DataFrame:
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias(name))


def ece(frame: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    return _weighted_gap(ece_bins(frame, keys, bins), keys, "ece")


def adaptive_bins(frame: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Bins between the distinct interpolated quantiles of p; one distinct quantile makes one bin."""
    f = valid(frame)
    edges = f.groupBy(*keys).agg(F.array_distinct(F.percentile("p", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("edges"))
    at = F.size(F.filter("edges", lambda e: e <= F.col("p")))
    k = F.greatest(F.lit(1), F.least(at, F.size("edges") - 1)).cast("int")
    g = f.join(edges, keys).withColumn("bin", k).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))
    return g.withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))


def ece_adaptive(frame: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over adaptive bins."""
    return _weighted_gap(adaptive_bins(frame, keys, bins), keys, "ece_adaptive")


def n_eff(frame: DataFrame, keys: list[str], horizon: int, order: str = "idx") -> DataFrame:
    """Effective sample size of the residuals p - y with Bartlett weights over lags below the horizon."""
    f = valid(frame).withColumn("r", F.col("p") - F.col("y"))
    w = Window.partitionBy(*keys)
    f = f.withColumn("d", F.col("r") - F.avg("r").over(w))
    o = w.orderBy(order)
    for k in range(1, horizon):
        f = f.withColumn(f"l{k}", F.col("d") * F.lag("d", k).over(o))
    s = f.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("d") * F.col("d")).alias("var"), *[F.avg(f"l{k}").alias(f"c{k}") for k in range(1, horizon)])
    inflate = F.lit(1.0)
    for k in range(1, horizon):
        inflate = inflate + 2 * (1 - k / horizon) * F.coalesce(F.col(f"c{k}"), F.lit(0.0)) / F.col("var")
    n = F.col("n").cast("double")
    plain = (F.lit(horizon) <= 1) | (n <= horizon) | (F.col("var") < 1e-15) | (inflate <= 0)
    return s.select(*keys, F.when(plain, n).otherwise(F.greatest(F.lit(1.0), F.least(n, n / inflate))).alias("n_eff"))


def crps(q: Column, x: Column) -> Column:
    """CRPS of a quantile forecast at LEVELS by the midpoint rule; intervals without width are skipped."""

    def one(i: Column) -> Column:
        lo, hi = F.get(q, i), F.get(q, i + 1)
        mid, at = (F.get(F.array(*map(F.lit, LEVELS)), i) + F.get(F.array(*map(F.lit, LEVELS)), i + 1)) / 2, (lo + hi) / 2
        inside = mid - F.when(x <= at, 1.0).otherwise(0.0)
        return F.when(hi > lo, inside * inside * (hi - lo)).otherwise(0.0)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(LEVELS) - 2)), F.lit(0.0), lambda a, i: a + one(i))


def pit(q: Column, x: Column) -> Column:
    """Where x falls in a quantile forecast: linear between levels, the outer levels beyond them, the middle of a flat stretch."""
    levels = F.array(*map(F.lit, LEVELS))
    last = len(LEVELS) - 1
    k = F.size(F.filter(q, lambda v: v <= x)) - 1
    lo, hi = F.get(q, k), F.get(q, k + 1)
    a, b = F.get(levels, k), F.get(levels, k + 1)
    inner = F.when(hi > lo, a + (b - a) * (x - lo) / (hi - lo)).otherwise((a + b) / 2)
    return F.when(k < 0, LEVELS[0]).when(k >= last, LEVELS[-1]).otherwise(inner)


def ks_uniform(frame: DataFrame, keys: list[str], value: str = "pit") -> DataFrame:
    """Kolmogorov-Smirnov distance of ``value`` to the uniform law."""
    w = Window.partitionBy(*keys)
    f = frame.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w.orderBy(value))).withColumn("n", F.count("*").over(w))
    d = F.greatest(F.col("i") / F.col("n") - F.col(value), F.col(value) - (F.col("i") - 1) / F.col("n"))
    return f.groupBy(*keys).agg(F.max(d).alias("ks"))


def coverage_error(frame: DataFrame, keys: list[str], lo: Column, hi: Column, x: Column, nominal: float) -> DataFrame:
    """|share of x within [lo, hi] - nominal|."""
    return frame.where(x.isNotNull()).groupBy(*keys).agg(F.abs(F.avg(F.when((x >= lo) & (x <= hi), 1.0).otherwise(0.0)) - nominal).alias("coverage_error"))


def sharpness(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Deviation, interquartile range and range of p, and the share more than five points from the event rate; at least 10 rows."""
    f = valid(frame)
    rate = f.groupBy(*keys).agg(F.avg("y").alias("rate"))
    q = F.percentile("p", F.array(F.lit(0.25), F.lit(0.75)))
    far = F.avg(F.when(F.abs(F.col("p") - F.col("rate")) > 0.05, 1.0).otherwise(0.0))
    g = f.join(rate, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("p").alias("sd"), (q[1] - q[0]).alias("iqr"), (F.max("p") - F.min("p")).alias("span"), far.alias("far"))
    return g.where("n >= 10").drop("n")


def conditional_ece(frame: DataFrame, keys: list[str], by: str, bins: int = 10, least: int = 30) -> DataFrame:
    """Calibration error within thirds of ``by``; thirds below ``least`` rows are left out."""
    f = valid(frame).where(F.col(by).isNotNull())
    cuts = f.groupBy(*keys).agg(F.percentile(by, F.array(F.lit(0.33), F.lit(0.67))).alias("c"))
    third = F.when(F.col(by) < F.col("c")[0], "low").when(F.col(by) > F.col("c")[1], "high").otherwise("mid")
    g = ece_bins(f.join(cuts, keys).withColumn("third", third), [*keys, "third"], bins)
    s = g.groupBy(*keys, "third").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
    return s.where(F.col("n") >= least)


def tail_risk(frame: DataFrame, keys: list[str], value: str = "ret", level: float = 0.95) -> DataFrame:
    """Value at risk and its conditional mean loss; at least 10 rows."""
    f = frame.where(F.col(value).isNotNull())
    cut = f.groupBy(*keys).agg(F.percentile(value, F.lit(1 - level)).alias("cut"), F.count("*").alias("n")).where("n >= 10")
    return f.join(cut, keys).groupBy(*keys).agg((-F.first("cut")).alias("var"), (-F.avg(F.when(F.col(value) <= F.col("cut"), F.col(value)))).alias("cvar"))


def reliability(frame: DataFrame, keys: list[str], bins: int = 10, z: float = 1.96) -> DataFrame:
    """Bins with the Wilson interval of their event rate."""
    g = ece_bins(frame, keys, bins)
    n, p = F.col("n").cast("double"), F.col("mean_y")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return g.withColumn("wilson_lo", mid - half).withColumn("wilson_hi", mid + half)


def aic_bic(frame: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Information criteria of the log likelihood with k parameters."""
    g = valid(frame).groupBy(*keys).agg((-F.sum(log_loss_term(F.col("p"), F.col("y")))).alias("ll"), F.count("*").alias("n"))
    return g.select(*keys, (2 * k - 2 * F.col("ll")).alias("aic"), (k * F.log("n") - 2 * F.col("ll")).alias("bic"))


def fdr(frame: DataFrame, keys: list[str], p: str = "p_value") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values; null ones stay null and do not count."""
    w = Window.partitionBy(*keys)
    f = frame.where(F.col(p).isNotNull())
    f = f.withColumn("_r", F.row_number().over(w.orderBy(p))).withColumn("_n", F.count("*").over(w))
    f = f.withColumn("_a", F.col(p) * F.col("_n") / F.col("_r"))
    back = w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_a").over(back))).drop("_r", "_n", "_a")
    return f.unionByName(frame.where(F.col(p).isNull()).withColumn("p_adjusted", F.lit(None).cast("double")))


def rolling_brier(frame: DataFrame, keys: list[str], n: int = 60, least: int = 30) -> DataFrame:
    """Mean squared error of the last n scored rows, null below ``least``."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(-(n - 1), 0)
    f = valid(frame)
    e = F.pow(F.col("p") - F.col("y"), 2)
    return f.withColumn("rolling_brier", F.when(F.count("*").over(w) >= least, F.avg(e).over(w)))


def hop_windows(frame: DataFrame, keys: list[str], size: int = 50, step: int = 10) -> DataFrame:
    """Scores of windows of ``size`` rows that start every ``step`` rows; complete windows only."""
    w = Window.partitionBy(*keys)
    f = valid(frame).withColumn("_i", F.row_number().over(w.orderBy("idx")) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / step)).cast("int")
    hops = F.explode(F.sequence(first, F.floor(F.col("_i") / step).cast("int"))).alias("hop")
    g = f.select("*", hops).groupBy(*keys, "hop").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg("y").alias("rate"))
    return g.where(F.col("n") == size)


def every_hth(frame: DataFrame, keys: list[str], horizon: str = "horizon") -> DataFrame:
    """Every h-th scored row, so that outcomes do not overlap."""
    w = Window.partitionBy(*keys).orderBy("idx")
    return valid(frame).withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % F.col(horizon) == 0).drop("_i")


def drawdown(frame: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """Largest fall from a running peak, with the positions of trough and peak."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    f = frame.withColumn("_m", F.max(price).over(w)).withColumn("_p", F.max(F.when(F.col(price) == F.col("_m"), F.col("idx"))).over(w))
    d = F.col(price) / F.col("_m") - 1
    best = F.min_by(F.struct("idx", "_p"), F.struct(d, "idx"))
    return f.groupBy(*keys).agg(F.min(d).alias("max_drawdown"), best.alias("b")).select(*keys, "max_drawdown", F.col("b.idx").alias("trough_idx"), F.col("b._p").alias("peak_idx"))
