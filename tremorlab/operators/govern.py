"""Cross-validation folds, promotion gates, benchmarks, pairwise and overfit reports over out-of-fold tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlab.operators import metrics as M
from tremorlab.operators.quantile import quantiles

GATES = {"bss": (0.0, ">="), "auc": (0.55, ">="), "ece": (0.02, "<=")}


def folds(frame: DataFrame, k: int = 5, train_share: float = 0.4) -> DataFrame:
    """fold 0..k-1 by position after the first ``train_share`` of each series; rows of the remainder are dropped.

    Predictions are causal, so one walk serves every fold: only labels that reach past their fold's end become null.
    """
    w = Window.partitionBy("ticker")
    n = F.max("idx").over(w) + 1
    start = F.floor(n * train_share)
    size = F.floor((n - start) / k)
    f = frame.withColumn("_s", start).withColumn("_z", size).withColumn("fold", F.floor((F.col("idx") - F.col("_s")) / F.col("_z")).cast("int"))
    f = f.where((F.col("idx") >= F.col("_s")) & (F.col("fold") < k))
    end = F.col("_s") + (F.col("fold") + 1) * F.col("_z")
    return f.withColumn("y", F.when(F.col("idx") + F.col("horizon") < end, F.col("y"))).drop("_s", "_z")


def all_scores(frame: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """n, positives, rate, Brier skill, mid-rank AUC and equal-width calibration error in one walk over the rows.

    Rows are first counted by distinct probability; every score follows from these counts.
    """
    f = M.valid(frame).groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    p, a, b = F.col("p"), F.col("pos"), F.col("neg")
    below = F.sum("neg").over(Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("_won", a * (F.coalesce(below, F.lit(0.0)) + b / 2)).withColumn("_bin", F.least(F.floor(p * bins), F.lit(bins - 1)))
    gaps = [F.abs(F.sum(F.when(F.col("_bin") == k, p * (a + b) - a).otherwise(0.0))) for k in range(bins)]
    total, pos, neg = F.sum(a + b), F.sum(a), F.sum(b)
    g = f.groupBy(*keys).agg(total.alias("_n"), pos.alias("pos"), neg.alias("_neg"), F.sum(a * F.pow(1 - p, 2) + b * p * p).alias("_sq"), F.sum("_won").alias("_won"), *[x.alias(f"_g{k}") for k, x in enumerate(gaps)])
    n, rate = F.col("_n"), F.col("pos") / F.col("_n")
    ref = rate * (1 - rate)
    ece = sum((F.col(f"_g{k}") for k in range(1, bins)), F.col("_g0")) / n
    return g.select(
        *keys,
        n.cast("long").alias("n"),
        "pos",
        rate.alias("rate"),
        F.when(ref >= 1e-15, 1 - F.col("_sq") / n / ref).alias("bss"),
        F.when((F.col("pos") > 0) & (F.col("_neg") > 0), F.col("_won") / (F.col("pos") * F.col("_neg"))).alias("auc"),
        ece.alias("ece"),
    )


def fold_summary(oof: DataFrame) -> DataFrame:
    """By config and horizon: mean and sample deviation of fold scores, rows, rank by mean skill (nulls unranked)."""
    s = all_scores(oof, ["config", "fold", "horizon"]).groupBy("config", "horizon")
    g = s.agg(F.avg("bss").alias("bss_mean"), F.stddev_samp("bss").alias("bss_sd"), F.avg("auc").alias("auc_mean"), F.avg("ece").alias("ece_mean"), F.count("*").alias("folds"), F.sum("n").alias("n"))
    w = Window.partitionBy("horizon").orderBy(F.col("bss_mean").desc_nulls_last())
    return g.withColumn("rank", F.when(F.col("bss_mean").isNotNull(), F.rank().over(w)).cast("int"))


def by_regime(frame: DataFrame, keys: list[str], sigma: str = "vol_20") -> DataFrame:
    """Every row under slice ``all`` and, if its volatility is known, under its third, by the 33rd and 66th percentile, strictly."""
    cuts = quantiles(frame, keys, sigma, [0.33, 0.66], "_c")
    third = F.when(F.col(sigma) < F.col("_c")[0], "low").when(F.col(sigma) > F.col("_c")[1], "high").otherwise("mid")
    slices = F.when(F.col(sigma).isNull(), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), third))
    f = frame.join(cuts, keys, "left").withColumn("slice", F.explode(slices))
    return f.drop("_c")


def gate_report(frame: DataFrame, keys: list[str], least: int = 100, least_class: int = 30, gates: dict | None = None) -> DataFrame:
    """One row per group and gate: value, threshold, margin, enough, passed (null without enough rows of both classes)."""
    gates = gates or GATES
    s = all_scores(frame, keys)
    enough = (F.col("n") >= least) & (F.col("pos") >= least_class) & (F.col("n") - F.col("pos") >= least_class)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("threshold"), F.lit(1 if o == ">=" else -1).alias("sign")) for m, (t, o) in gates.items()])).alias("g")
    g = s.select(*keys, "n", enough.alias("enough"), rows).select(*keys, "n", "enough", "g.*")
    margin = (F.col("value") - F.col("threshold")) * F.col("sign")
    g = g.withColumn("margin", margin).drop("sign")
    return g.withColumn("passed", F.when(F.col("enough") & F.col("value").isNotNull(), F.col("margin") >= 0))


def promotion(report: DataFrame, keys: list[str]) -> DataFrame:
    """UNDECIDED where a gate lacks rows, PASS where all passed, else FAIL."""
    g = report.groupBy(*keys).agg(F.bool_and("enough").alias("e"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("p"))
    return g.select(*keys, F.when(~F.col("e"), "UNDECIDED").when(F.col("p"), "PASS").otherwise("FAIL").alias("status"))


def annotate(report: DataFrame, keys: list[str]) -> DataFrame:
    """The report with whether all gates of the group passed."""
    return report.withColumn("all_passed", F.bool_and(F.coalesce("passed", F.lit(False))).over(Window.partitionBy(*keys)))


def benchmark(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Skill over the climatology of the group's own rows."""
    # a group's mean forecast errs by the variance of its outcomes, so sums that combine before the shuffle do
    rate = F.avg("y")
    g = M.valid(frame).groupBy(*keys).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("model"), (F.avg(F.col("y") * F.col("y")) - rate * rate).alias("climate"))
    return g.withColumn("skill", F.when(F.col("climate") > 1e-15, 1 - F.col("model") / F.col("climate")))


def pairwise(frame: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Mean loss difference of every pair of configurations (first name smaller) on their common rows."""
    e = M.valid(frame).select("config", *on, F.pow(F.col("p") - F.col("y"), 2).alias("loss"))
    j = e.alias("a").join(e.alias("b"), on).where("a.config < b.config")
    return j.groupBy(F.col("a.config").alias("a"), F.col("b.config").alias("b"), *keys).agg(F.count("*").alias("n"), F.avg(F.col("a.loss") - F.col("b.loss")).alias("diff"))


def status(value: Column, green: float, yellow: float, lower_is_better: bool = True) -> Column:
    """GREEN / YELLOW / RED by two limits."""
    v, g, y = (value, green, yellow) if lower_is_better else (-value, -green, -yellow)
    return F.when(v <= g, "GREEN").when(v <= y, "YELLOW").otherwise("RED")


def stars(p: Column) -> Column:
    """Significance marks."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def overfit(oof: DataFrame) -> DataFrame:
    """Deviation over mean of fold calibration errors and late against early folds, with lights."""
    s = all_scores(oof, ["config", "fold", "horizon"]).groupBy("config", "horizon").agg(
        (F.stddev_samp("ece") / F.avg("ece")).alias("fold_cv"),
        F.avg(F.when(F.col("fold") <= 1, F.col("ece"))).alias("early"),
        F.avg(F.when(F.col("fold") >= 3, F.col("ece"))).alias("late"),
    )
    f = s.withColumn("drift", F.col("late") / F.col("early") - 1)
    return f.withColumn("cv_status", status(F.col("fold_cv"), 0.3, 0.6)).withColumn("drift_status", status(F.col("drift"), 0.25, 0.75))


def worst(frame: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The worst light of several columns and rows, and whether it is acceptable."""
    rank = F.greatest(*[F.when(F.col(c) == "RED", 2).when(F.col(c) == "YELLOW", 1).otherwise(0) for c in cols])
    g = frame.groupBy(*keys).agg(F.max(rank).alias("r"))
    return g.select(*keys, F.when(F.col("r") == 2, "RED").when(F.col("r") == 1, "YELLOW").otherwise("GREEN").alias("worst"), (F.col("r") <= 1).alias("acceptable"))


def threshold_sensitivity(labels: DataFrame, shifts: tuple[float, ...] = (0.9, 1.0, 1.1)) -> DataFrame:
    """Event rate by ticker and horizon where tau is scaled."""
    f = labels.where("ret_h is not null").withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    return f.groupBy("ticker", "horizon", "shift").agg(F.avg(F.when(F.abs("ret_h") >= F.col("tau") * F.col("shift"), 1.0).otherwise(0.0)).alias("rate"))


def slices(frame: DataFrame, **columns: Column) -> DataFrame:
    """Rows once for each named slicing, as columns slicing and slice."""
    parts = [frame.withColumn("slicing", F.lit(n)).withColumn("slice", c) for n, c in columns.items()]
    return reduce(DataFrame.unionByName, parts)
