"""Bootstrap p-values and intervals by group."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_indices(rng: np.random.Generator, n: int, block: int, rounds: int) -> np.ndarray:
    """rounds x n positions of a circular block bootstrap; block 1 is the plain one."""
    k = -(-n // block)
    start = rng.integers(0, n, (rounds, k))
    return ((start[:, :, None] + np.arange(block)) % n).reshape(rounds, -1)[:, :n]


def _rng(key: tuple, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(key).encode())])


def paired_pvalue(frame: DataFrame, keys: list[str], diff: str = "diff", order: str = "idx", block: int = 1, rounds: int = 500, seed: int = 42) -> DataFrame:
    """One-sided p-value that the mean of ``diff`` is not below zero: the share of resampled means at or above it.

    Each group is one series' differences. Resampled means are taken in slices, so memory stays with the group's size.
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        d = g.sort_values(order)[diff].dropna().to_numpy()
        if len(d) < 10:
            p = None
        else:
            rng, step = _rng(key, seed), max(1, 2_000_000 // len(d))
            means = np.concatenate([d[block_indices(rng, len(d), block, min(step, rounds - at))].mean(axis=1) for at in range(0, rounds, step)])
            p = float(np.mean(means >= 0))
        return pd.DataFrame([[*key, len(d), p]], columns=[*keys, "n", "p_value"])

    schema = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys) + ", n long, p_value double"
    return frame.select(*keys, order, diff).groupBy(*keys).applyInPandas(run, schema)


def brier_skill(p: np.ndarray, y: np.ndarray) -> float:
    ref = y.mean() * (1 - y.mean())
    return 1 - np.mean((p - y) ** 2) / ref if ref > 1e-15 else np.nan


def calibration_error(p: np.ndarray, y: np.ndarray, bins: int = 10) -> float:
    k = np.minimum((p * bins).astype(int), bins - 1)
    return float(np.abs(np.bincount(k, p - y, bins)).sum() / len(p))


def bca_interval(p: np.ndarray, y: np.ndarray, metric: Callable, rng: np.random.Generator, rounds: int, block: int = 1, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated interval; plain percentiles with few finite values, none below 10 rows."""
    n = len(p)
    if n < 10:
        return np.nan, np.nan
    boot = np.array([metric(p[i], y[i]) for i in block_indices(rng, n, block, rounds)])
    boot = boot[np.isfinite(boot)]
    tails = np.array([(1 - level) / 2, (1 + level) / 2])
    if len(boot) < 100:
        return tuple(np.quantile(boot, tails)) if len(boot) else (np.nan, np.nan)
    at = metric(p, y)
    nd = NormalDist()
    z0 = nd.inv_cdf(float(np.clip(np.mean(boot < at), 0.001, 0.999)))
    keep = np.arange(n)
    some = keep if n <= 400 else np.linspace(0, n - 1, 400).astype(int)  # jackknife of groups of rows where there are many
    parts = np.array_split(keep, len(some))
    jack = np.array([metric(np.delete(p, s), np.delete(y, s)) for s in parts])
    d = jack.mean() - jack
    acc = (d**3).sum() / (6 * max((d**2).sum() ** 1.5, 1e-30))
    adj = [nd.cdf(z0 + (z0 + nd.inv_cdf(t)) / (1 - acc * (z0 + nd.inv_cdf(t)))) for t in tails]
    return tuple(float(v) for v in np.quantile(boot, np.clip(adj, 0.001, 0.999)))


METRICS = {"bss": brier_skill, "ece": calibration_error, "brier": lambda p, y: float(np.mean((p - y) ** 2))}


def metric_intervals(frame: DataFrame, keys: list[str], metric: str | Callable = "bss", order: str = "idx", block: int = 1, rounds: int = 300, seed: int = 42) -> DataFrame:
    """The metric of each group with its BCa interval; ``metric`` is a name or any function of (p, y)."""
    fn = METRICS[metric] if isinstance(metric, str) else metric

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order).dropna(subset=["p", "y"])
        p, y = g["p"].to_numpy(), g["y"].to_numpy()
        lo, hi = bca_interval(p, y, fn, _rng(key, seed), rounds, block)
        return pd.DataFrame([[*key, len(p), float(fn(p, y)) if len(p) else None, lo, hi]], columns=[*keys, "n", "value", "ci_low", "ci_high"])

    schema = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys) + ", n long, value double, ci_low double, ci_high double"
    return frame.where(F.col("p").isNotNull() & F.col("y").isNotNull()).select(*keys, order, "p", "y").groupBy(*keys).applyInPandas(run, schema)
