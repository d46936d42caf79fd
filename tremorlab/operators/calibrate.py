"""Calibration of probabilities: ordered folds, histogram corrections and pair-averaging monotone fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlab.functions.scalar import logit, sigmoid
from tremorlab.operators import metrics as M


def platt_fold(frame: DataFrame, keys: list[str], lr: float = 0.05, warm_up: int = 50) -> DataFrame:
    """Final a, b of an online Platt scaling over the rows of each group by idx: step lr / sqrt(1 + n).

    The gradient uses the emitted probability, which is the raw one during warm-up. Groups are one
    series and horizon, so the array that the fold runs over is bounded by a series' length.
    """
    rows = F.array_sort(F.collect_list(F.struct("idx", "p", "y")))
    zero = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("n"))

    def step(s: Column, r: Column) -> Column:
        x = logit(r["p"])
        out = F.when(s["n"] < warm_up, r["p"]).otherwise(sigmoid(s["a"] * x + s["b"]))
        e, rate = out - r["y"], lr / F.sqrt(1 + s["n"].cast("double"))
        return F.struct((s["a"] - rate * e * x).alias("a"), (s["b"] - rate * e).alias("b"), (s["n"] + 1).alias("n"))

    g = M.valid(frame).groupBy(*keys).agg(F.aggregate(rows, zero, step).alias("s"))
    return g.select(*keys, "s.a", "s.b", "s.n")


def histogram_correction(frame: DataFrame, keys: list[str], bins: int = 10, least: int = 15, prior: float = 15.0) -> DataFrame:
    """Additive correction by equal-width bin, shrunk by n / (n + prior); 0 below ``least`` rows."""
    g = M.ece_bins(frame, keys, bins)
    n = F.col("n").cast("double")
    return g.withColumn("correction", F.when(F.col("n") >= least, n / (n + prior) * (F.col("mean_y") - F.col("mean_p"))).otherwise(0.0))


def apply_histogram(frame: DataFrame, corrections: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """p_cal: p plus its bin's correction, within 0 and 1."""
    k = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    c = corrections.select(*keys, "bin", "correction")
    return frame.withColumn("bin", k).join(F.broadcast(c), [*keys, "bin"], "left").withColumn("p_cal", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.coalesce("correction", F.lit(0.0))))).drop("bin", "correction")


def pair_average(values: Column, sweeps: int) -> Column:
    """Up to ``sweeps`` passes in which each falling neighbour pair, from the left, is replaced by its mean.

    This is not the weighted block method: a pair's mean may fall below an earlier value until the next pass.
    """

    def one_pass(v: Column) -> Column:
        zero = F.array().cast("array<double>")

        def add(a: Column, x: Column) -> Column:
            last = F.element_at(a, -1)
            m = (last + x) / 2
            return F.when(F.size(a) == 0, F.array(x)).when(last > x, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(m, m))).otherwise(F.concat(a, F.array(x)))

        return F.aggregate(v, zero, add)

    return F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), values, lambda v, _: one_pass(v))


def ensemble(weights: dict[int, float]) -> Column:
    """Weighted sum of the calibrated probabilities p_5, p_10 and so on."""
    out = F.lit(0.0)
    for h, w in weights.items():
        out = out + w * F.col(f"p_{h}")
    return out


def platt_trace(frame: DataFrame, keys: list[str], lr: float = 0.05, warm_up: int = 50) -> DataFrame:
    """a and b after every row of each group, for convergence diagnostics; as in platt_fold, a group is one series."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "p", "y")))
    zero = F.array(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("n")))

    def step(states: Column, r: Column) -> Column:
        s = F.element_at(states, -1)
        x = logit(r["p"])
        out = F.when(s["n"] < warm_up, r["p"]).otherwise(sigmoid(s["a"] * x + s["b"]))
        e, rate = out - r["y"], lr / F.sqrt(1 + s["n"].cast("double"))
        return F.concat(states, F.array(F.struct((s["a"] - rate * e * x).alias("a"), (s["b"] - rate * e).alias("b"), (s["n"] + 1).alias("n"))))

    g = M.valid(frame).groupBy(*keys).agg(F.aggregate(rows, zero, step).alias("t"))
    return g.select(*keys, F.explode("t").alias("s")).select(*keys, "s.a", "s.b", "s.n")


def convergence(trace: DataFrame, keys: list[str], recent: int = 50, span: int = 100) -> DataFrame:
    """Mean absolute step of a over the last ``recent`` updates and its range over the last ``span``, at the end of each group."""
    w = Window.partitionBy(*keys).orderBy("n")
    f = trace.withColumn("_d", F.abs(F.col("a") - F.lag("a").over(w)))
    f = f.withColumn("velocity", F.avg("_d").over(w.rowsBetween(-(recent - 1), 0))).withColumn("spread", F.max("a").over(w.rowsBetween(-(span - 1), 0)) - F.min("a").over(w.rowsBetween(-(span - 1), 0)))
    return f.groupBy(*keys).agg(F.max_by("velocity", "n").alias("velocity"), F.max_by("spread", "n").alias("spread"))
