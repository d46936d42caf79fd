"""Studies over configurations: offline pooled calibration, learned baselines, parameter search, seeds and ablations."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlab.functions.scalar import logit, sigmoid
from tremorlab.operators import metrics as M


def pooled_logistic(frame: DataFrame, columns: list[str], l2: float = 1e-3, rounds: int = 8) -> np.ndarray:
    """Intercept and weights by iteratively reweighted least squares: each round is one Spark aggregate of X'WX and X'Wz.

    Identity (0, 1 on the first column) with fewer than max(5k, 30) rows or one class. Only k x k sums reach the driver.
    """
    f = M.valid(frame).select("y", *columns).na.drop()
    k = len(columns) + 1
    x = [F.lit(1.0), *[F.col(c) for c in columns]]
    n, pos = f.agg(F.count("*"), F.sum("y")).first()
    w = np.zeros(k)
    w[1] = 1.0
    if n < max(5 * k, 30) or not pos or pos == n:
        return w
    for _ in range(rounds):
        eta = reduce(lambda a, b: a + b, (float(c) * v for c, v in zip(w, x)))
        mu = sigmoid(eta)
        weight = F.greatest(mu * (1 - mu), F.lit(1e-6))
        sums = [F.sum(weight * x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * (F.col("y") - mu)).alias(f"g{i}") for i in range(k)]
        r = f.agg(*sums).first()
        h = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        pen = l2 * n * np.eye(k)
        pen[0, 0] = 0.0
        step = np.linalg.solve(h + pen, np.array([r[f"g{i}"] for i in range(k)]) - pen @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def apply_logistic(frame: DataFrame, columns: list[str], w: np.ndarray, name: str = "p_cal") -> DataFrame:
    """Probability of a fitted logistic model."""
    eta = reduce(lambda a, b: a + b, (float(c) * F.col(n) for c, n in zip(w[1:], columns)), F.lit(float(w[0])))
    return frame.withColumn(name, sigmoid(eta))


def online_logistic_baseline(frame: DataFrame, lr: float = 0.05, l2: float = 1e-4, warm_up: int = 100) -> DataFrame:
    """Feature logistic learned online with labels that arrive ``horizon`` rows late; the base rate during warm-up."""
    cols = ["vol_20", "vol_40", "vol_60", "vov_strided", "abs_ret_5"]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        x = np.column_stack([np.ones(len(g)), g[cols].astype(float).fillna(0.0).to_numpy() * 5])
        y, at, base = g["y"].to_numpy(dtype=float), g["idx"].to_numpy(), g["base"].to_numpy(dtype=float)
        w, n, j, out = np.zeros(x.shape[1]), 0, 0, []
        for i in range(len(g)):
            while at[i] - at[j] >= int(key[1]):
                if np.isfinite(y[j]):
                    p = 1 / (1 + np.exp(-np.clip(w @ x[j], -50, 50)))
                    w -= lr / math.sqrt(1 + n) * ((p - y[j]) * x[j] + l2 * w)
                    n += 1
                j += 1
            p = base[i] if n < warm_up else 1 / (1 + np.exp(-np.clip(w @ x[i], -50, 50)))
            out.append(min(max(p, 0.001), 0.999))
        return g.assign(p=out)[["ticker", "idx", "horizon", "y", "p"]]

    return frame.select("ticker", "idx", "horizon", "y", "base", *cols).groupBy("ticker", "horizon").applyInPandas(run, "ticker string, idx int, horizon int, y double, p double")


def boosted_baseline(frame: DataFrame, split: int, columns: list[str], trees: int = 10, depth: int = 3) -> DataFrame:
    """Gradient-boosted trees of the ML library, fitted on rows whose labels are known at ``split`` and applied after it."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    f = VectorAssembler(inputCols=columns, outputCol="x").transform(frame.na.drop(subset=columns))
    train = M.valid(f.withColumn("p", F.lit(0.5))).where(F.col("idx") + F.col("horizon") <= split)
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, seed=42).fit(train.select("x", "y"))
    p = vector_to_array("probability")[1]
    return model.transform(f.where(F.col("idx") > split)).select("ticker", "idx", "horizon", "y", F.greatest(F.lit(0.001), F.least(F.lit(0.999), p)).alias("p"))


def window_trials(labels: DataFrame, trials: list[dict]) -> DataFrame:
    """Skill and calibration error of base rates shrunk to one half, for each trial (window, prior), in one job.

    The trials are a small table crossed with nothing: each is a column expression over the same sort.
    """
    w = Window.partitionBy("ticker", "horizon").orderBy("idx")
    parts = []
    for t in trials:
        over = w.rowsBetween(-int(t["window"]), -11)
        n = F.count("y").over(over)
        parts.append(F.struct(F.lit(t["trial"]).alias("trial"), ((F.coalesce(F.sum("y").over(over), F.lit(0.0)) + t["prior"] * 0.5) / (n + t["prior"])).alias("p")))
    f = labels.select("ticker", "idx", "horizon", "y", F.array(*parts).alias("cs")).withColumn("c", F.explode("cs")).select("*", "c.*").where("idx >= 252")
    from tremorlab.operators.govern import all_scores

    return all_scores(f, ["trial"])


def search(labels: DataFrame, rounds: int = 2, per_round: int = 6, seed: int = 42) -> list[dict]:
    """Parameter search: random trials first, then draws near the better half (a Parzen window on log scales); gives all trials by objective."""
    rng = np.random.default_rng(seed)
    done: list[dict] = []
    for k in range(rounds):
        good = sorted(done, key=lambda t: t["ece"])[: max(1, len(done) // 2)]
        new = []
        for _ in range(per_round):
            if good:
                c = good[rng.integers(len(good))]
                window, prior = c["window"] * np.exp(rng.normal(0, 0.3)), c["prior"] * np.exp(rng.normal(0, 0.5))
            else:
                window, prior = np.exp(rng.uniform(np.log(30), np.log(500))), np.exp(rng.uniform(np.log(1), np.log(100)))
            new.append({"trial": len(done) + len(new), "window": int(np.clip(window, 20, 600)), "prior": float(np.clip(prior, 0.5, 200))})
        scores = {r["trial"]: r for r in window_trials(labels, new).collect()}  # one row a trial
        done += [t | {"ece": float(scores[t["trial"]]["ece"]), "bss": scores[t["trial"]]["bss"]} for t in new]
    return sorted(done, key=lambda t: t["ece"])


def as_table(spark: SparkSession, trials: list[dict]) -> DataFrame:
    """The trial table."""
    return spark.createDataFrame([(t["trial"], t["window"], t["prior"], t["ece"], t["bss"]) for t in trials], "trial int, window int, prior double, ece double, bss double")


def logit_column(frame: DataFrame, p: str = "p") -> DataFrame:
    return frame.withColumn("x_logit", logit(F.col(p)))
