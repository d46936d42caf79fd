"""Window features of price panels: returns, labels, volatility, regimes, thresholds.

A panel has columns ticker, dt, idx (position within the ticker), price, open, high, low, volume.
Every feature is a window that ends at the current row or earlier; only labels look ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlab.operators.quantile import quantiles

HORIZONS = (5, 10)


def W() -> Window:
    """Rows of a ticker in time order."""
    return Window.partitionBy("ticker").orderBy("dt")


def last(n: int) -> Window:
    """The last n rows, the current one included."""
    return W().rowsBetween(-(n - 1), 0)


def PAST() -> Window:
    """All rows up to the current one."""
    return W().rowsBetween(Window.unboundedPreceding, 0)


def with_returns(panel: DataFrame) -> DataFrame:
    """Simple and log return of each day over the day before."""
    back = F.lag("price").over(W())
    return panel.withColumn("ret", F.col("price") / back - 1).withColumn("log_ret", F.log(F.col("price") / back))


def forward_returns(panel: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row per day and horizon with ret_h = price h rows later / price - 1, null past the end.

    All leads share the panel's one sort; horizons become rows afterwards.
    """
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.lead("price", h).over(W()) / F.col("price") - 1).alias("ret_h")) for h in horizons])
    return panel.withColumn("_h", ahead).withColumn("_h", F.explode("_h")).select("*", "_h.horizon", "_h.ret_h").drop("_h")


def adaptive_thresholds(labels: DataFrame, q: float = 0.8) -> DataFrame:
    """tau per horizon: the exact q-quantile of |ret_h|."""
    return quantiles(labels.withColumn("_size", F.abs("ret_h")), ["horizon"], "_size", [q]).select("horizon", F.col("q")[0].alias("tau"))


def label_moves(labels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """y = 1 where |ret_h| reaches tau, 0 below, null without an outcome. ``thresholds`` has one row per horizon."""
    y = F.when(F.col("ret_h").isNull(), None).when(F.abs("ret_h") >= F.col("tau"), 1.0).otherwise(0.0)
    return labels.join(F.broadcast(thresholds), "horizon").withColumn("y", y)


def rolling_base_rate(labelled: DataFrame, window: int = 252) -> DataFrame:
    """base = mean label of the ``window`` rows that end h + 1 rows back, the latest whose outcome is known; 0 without any."""
    w = Window.partitionBy("ticker", "horizon").orderBy("dt")
    rate = None
    for h in HORIZONS:
        over = F.avg("y").over(w.rowsBetween(-window, -(h + 1)))
        rate = F.when(F.col("horizon") == h, over) if rate is None else rate.when(F.col("horizon") == h, over)
    return labelled.withColumn("base", F.coalesce(rate, F.lit(0.0)))


def realized_vol(frame: DataFrame, n: int = 20) -> DataFrame:
    """Population deviation of the last n returns, null before n of them exist."""
    w = last(n)
    return frame.withColumn(f"vol_{n}", F.when(F.count("ret").over(w) == n, F.stddev_pop("ret").over(w)))


def vol_state(frame: DataFrame) -> DataFrame:
    """vol_ratio to the expanding deviation, 20-row change and 60-row deviation of the 20-day volatility."""
    f = realized_vol(frame).withColumn("sigma", F.stddev_pop("ret").over(PAST()))
    ratio = F.when(F.col("vol_20").isNull() | (F.col("sigma") <= 0), 1.0).otherwise(F.col("vol_20") / F.col("sigma"))
    w60 = last(60)
    return (
        f.withColumn("vol_ratio", ratio)
        .withColumn("delta_sigma", F.coalesce(F.col("vol_20") - F.lag("vol_20", 20).over(W()), F.lit(0.0)))
        .withColumn("vol_of_vol", F.when(F.count("vol_20").over(w60) == 60, F.stddev_pop("vol_20").over(w60)).otherwise(0.0))
    )


def percentile_rank(frame: DataFrame, value: str = "vol_20", n: int = 252) -> DataFrame:
    """Share of the last n values, the current one included, that lie strictly below it."""
    seen = F.collect_list(value).over(last(n))
    below = F.size(F.filter(seen, lambda x: x < F.col(value)))
    return frame.withColumn("pct", F.when(F.col(value).isNotNull(), below / F.size(seen)))


def regime(frame: DataFrame, warm_up: int = 252) -> DataFrame:
    """low / mid / high by the percentile rank; mid while fewer than ``warm_up`` values are known."""
    known = F.count("vol_20").over(PAST())
    state = F.when((known < warm_up) | F.col("pct").isNull(), "mid").when(F.col("pct") < 0.25, "low").when(F.col("pct") > 0.75, "high").otherwise("mid")
    return frame.withColumn("regime", state)


def regime_bin(frame: DataFrame, bins: int = 3) -> DataFrame:
    """Bin number of the percentile rank; 0 before 50 values."""
    k = F.least(F.floor(F.col("pct") * bins), F.lit(bins - 1)).cast("int")
    return frame.withColumn("regime_bin", F.when(F.count("vol_20").over(PAST()) < 50, 0).otherwise(F.coalesce(k, F.lit(0))))


def gated_threshold(frame: DataFrame, k: float = 2.0, fixed: dict[int, float] | None = None) -> DataFrame:
    """Fixed threshold in low and mid regimes; k * expanding sigma * sqrt(h) in the high one."""
    fixed = fixed or {5: 0.3, 10: 0.4}
    lookup = F.element_at(F.create_map(*[x for h, t in fixed.items() for x in (F.lit(h), F.lit(t))]), F.col("horizon"))
    anchored = F.lit(k) * F.col("sigma") * F.sqrt("horizon")
    return frame.withColumn("thr_fixed", lookup).withColumn("thr_anchored", anchored).withColumn("thr", F.when(F.col("regime") == "high", anchored).otherwise(lookup))


def range_features(panel: DataFrame) -> DataFrame:
    """Parkinson variance and its 20-row root mean, overnight gap and its variance, intraday range."""
    ok = (F.col("high") > 0) & (F.col("low") > 0) & (F.col("high") >= F.col("low"))
    park = F.when(ok, F.pow(F.log(F.col("high") / F.col("low")), 2) / (4 * F.log(F.lit(2.0))))
    gap = F.log(F.col("open") / F.lag("price").over(W()))
    f = panel.withColumn("parkinson", park).withColumn("gap", F.abs(gap)).withColumn("gap_var", gap * gap)
    f = f.withColumn("intraday", F.when(ok, F.log(F.col("high") / F.col("low"))))
    return f.withColumn("range_sigma", F.sqrt(F.avg("parkinson").over(last(20))))


def rolling_mean(frame: DataFrame, value: Column, n: int, name: str) -> DataFrame:
    """Mean of the last n values, of fewer at the start."""
    return frame.withColumn(name, F.avg(value).over(last(n)))


def ewma_vol(frame: DataFrame, span: int = 20) -> DataFrame:
    """Root of the exponentially weighted mean square return with adjusted weights, over the whole past.

    Series are cut into stretches of ``10 * span`` rows, within which a running sum of scaled squares gives the
    average; the last values of the four stretches before are carried in, and what lies further back is below a double's last digit.
    """
    keep, size = 1 - 2 / (span + 1), 10 * span
    at = F.col("idx") % size
    scale = F.pow(F.lit(keep), -at)
    f = frame.withColumn("_b", F.floor(F.col("idx") / size)).withColumn("_s", F.col("ret") * F.col("ret") * scale).withColumn("_w", F.when(F.col("ret").isNotNull(), scale))
    ends = f.groupBy("ticker", "_b").agg(*[(F.coalesce(F.sum(c), F.lit(0.0)) * keep ** (size - 1)).alias(f"_e{c}") for c in ("_s", "_w")])
    w = Window.partitionBy("ticker").orderBy("_b")
    carried = lambda c: sum((F.coalesce(F.lag(f"_e{c}", m).over(w), F.lit(0.0)) * keep ** (size * (m - 1)) for m in range(1, 5)), F.lit(0.0))
    before = ends.select("ticker", "_b", carried("_s").alias("_c_s"), carried("_w").alias("_c_w"))
    run = Window.partitionBy("ticker", "_b").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.pow(F.lit(keep), at) * (F.coalesce(F.sum(c).over(run), F.lit(0.0)) + keep * F.col(f"_c{c}"))
    out = f.join(before, ["ticker", "_b"]).withColumn("_ts", total("_s")).withColumn("_tw", total("_w"))
    return out.withColumn("ewma", F.when(F.col("_tw") > 0, F.sqrt(F.greatest(F.col("_ts") / F.col("_tw"), F.lit(1e-16))))).drop("_b", "_s", "_w", "_c_s", "_c_w", "_ts", "_tw")


def har_features(frame: DataFrame, value: Column | None = None) -> DataFrame:
    """Daily, weekly and monthly variance (squared returns, or ``value``) with targets over the next 1, 5 and 22 rows; complete rows only."""
    v = F.col("ret") * F.col("ret") if value is None else value
    ahead = lambda n: F.avg(v).over(W().rowsBetween(1, n))
    f = frame.withColumn("rv_1", v).withColumn("rv_5", F.avg(v).over(last(5))).withColumn("rv_22", F.avg(v).over(last(22)))
    f = f.withColumn("target_1", ahead(1)).withColumn("target_5", ahead(5)).withColumn("target_22", ahead(22)).withColumn("_n", F.count("ret").over(W().rowsBetween(1, 22)))
    return f.where((F.col("idx") >= 22) & (F.col("_n") == 22)).drop("_n")


def boost_flag(labelled: DataFrame, least: float = 0.02, window: int = 252) -> DataFrame:
    """Whether the mean of the last 252 known labels is under ``least``; false while fewer are known."""
    w = Window.partitionBy("ticker", "horizon").orderBy("dt")
    flag = None
    for h in HORIZONS:
        over = w.rowsBetween(-(window - 1 + h), -h)
        case = (F.count("y").over(over) == window) & (F.avg("y").over(over) < least)
        flag = F.when(F.col("horizon") == h, case) if flag is None else flag.when(F.col("horizon") == h, case)
    return labelled.withColumn("boost", flag)


def strided_features(frame: DataFrame) -> DataFrame:
    """Baseline model inputs: 20/40/60-row deviations, deviation of a 5-step strided volatility, 5-row absolute return."""
    f = frame
    for n in (20, 40, 60):
        f = realized_vol(f, n)
    lags = F.array_compact(F.array(*[F.lag("vol_20", 5 * k).over(W()) for k in range(12)]))
    m = F.aggregate(lags, F.lit(0.0), lambda a, x: a + x) / F.size(lags)
    sd = F.sqrt(F.aggregate(lags, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(lags))
    return f.withColumn("vov_strided", F.when(F.size(lags) == 12, sd)).withColumn("abs_ret_5", F.abs(F.col("price") / F.lag("price", 5).over(W()) - 1))


def era(dt: Column) -> Column:
    """Era of a date by fixed market breaks."""
    return F.when(dt <= F.lit("2020-02-19").cast("date"), "pre_covid").when(dt <= F.lit("2020-12-31").cast("date"), "covid").when(dt <= F.lit("2022-12-31").cast("date"), "post_covid").otherwise("recent")
