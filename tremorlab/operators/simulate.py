"""Monte Carlo probabilities of large moves, in Arrow batches, with seeds that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlab.operators.metrics import LEVELS

OUT = "p_raw double, se double, ci_low double, ci_high double, paths int, q array<double>"


def seed_column(run_seed: int) -> F.Column:
    """A stateless seed by (run, ticker, idx, horizon)."""
    return F.xxhash64(F.lit(run_seed), "ticker", "idx", "horizon")


def noise(rng: np.random.Generator, shape: int, df: float | None, pool: np.ndarray | None = None) -> np.ndarray:
    """Unit-variance shocks: resampled residuals, Student t (df > 2) or Gaussian."""
    if pool is not None and len(pool) >= 100:
        return rng.choice(pool, shape)
    if df is not None and df > 2:
        return rng.standard_t(df, shape) * np.sqrt((df - 2) / df)
    return rng.standard_normal(shape)


def terminal_returns(rng: np.random.Generator, sigma: float, horizon: int, paths: int, omega: float | None = None, alpha: float = 0.0, beta: float = 0.0, gamma: float = 0.0, df: float | None = None, jumps: tuple | None = None, pool: np.ndarray | None = None) -> np.ndarray:
    """Simple returns after ``horizon`` days; only the current step of each path is held.

    Without omega the volatility is constant. Jumps (rate a year, mean, deviation) are compensated in
    the drift; the sum of N of them is drawn as N mean + sqrt(N) deviation Z.
    """
    log_price, var = np.zeros(paths), np.full(paths, sigma * sigma)
    rate, mean, dev = jumps or (0.0, 0.0, 0.0)
    drift = -rate / 252 * (np.exp(mean + dev * dev / 2) - 1)
    for _ in range(horizon):
        z = noise(rng, paths, df, pool)
        e = np.sqrt(var) * z
        log_price += drift - var / 2 + e
        if rate:
            n = rng.poisson(rate / 252, paths)
            log_price += n * mean + np.sqrt(n) * dev * rng.standard_normal(paths)
        if omega is not None:
            var = np.maximum(omega + (alpha + gamma * (e < 0)) * e * e + beta * var, 1e-12)
    return np.expm1(log_price)


def move_probability(ret: np.ndarray, tau: float) -> tuple:
    """Probability of |return| >= tau, its standard error, 95 % interval, number of paths, nine quantiles."""
    p = float(np.mean(np.abs(ret) >= tau))
    se = float(np.sqrt(p * (1 - p) / len(ret)))
    return p, se, max(0.0, p - 1.96 * se), min(1.0, p + 1.96 * se), len(ret), np.quantile(ret, LEVELS).tolist()


def simulate(frame: DataFrame, paths: int = 2000, seed: int = 42, df: float | None = 5.0, boost: str | None = None) -> DataFrame:
    """``frame`` (ticker, idx, horizon, sigma_1d, tau; omega, alpha, beta, gamma and jump_* where known, t_df for its own degrees of freedom) with OUT.

    Rows where column ``boost`` holds use twice the paths. Rows without sigma or tau give nulls. Rows are dealt
    evenly before, since their cost is the same and a series may lie in one partition.
    """
    names = [c for c in ("t_df", "sigma_1d", "tau", "omega", "alpha", "beta", "gamma", "jump_rate", "jump_mean", "jump_dev") if c in frame.columns]
    f = frame.withColumn("_seed", seed_column(seed)).withColumn("_paths", F.when(F.col(boost), 2 * paths).otherwise(paths) if boost else F.lit(paths))
    cols = [*frame.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b[[*names, "horizon", "_seed", "_paths"]].to_dict("records"):
                s, tau = r["sigma_1d"], r["tau"]
                if not (s is not None and tau is not None and np.isfinite(s) and np.isfinite(tau)):
                    out.append((None, None, None, None, 0, None))
                    continue
                known = r.get("omega") is not None and np.isfinite(r["omega"])
                garch = {k: r[k] for k in ("omega", "alpha", "beta", "gamma")} if known else {}
                jumps = (r["jump_rate"], r["jump_mean"], r["jump_dev"]) if "jump_rate" in r else None
                rng = np.random.default_rng(int(r["_seed"]) % (1 << 63))
                out.append(move_probability(terminal_returns(rng, s, int(r["horizon"]), int(r["_paths"]), df=r.get("t_df", df), jumps=jumps, **garch), tau))
            got = pd.DataFrame(out, columns=["p_raw", "se", "ci_low", "ci_high", "paths", "q"], index=b.index)
            yield pd.concat([b[cols], got], axis=1)

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in frame.schema.fields) + ", " + OUT
    return f.repartition(*[c for c in ("ticker", "idx", "horizon") if c in cols]).mapInPandas(run, schema)


def regime_df(frame: DataFrame, low: float = 10.0, mid: float = 5.0, high: float = 4.0, pct: str = "pct", seen: str | None = None, least: int = 50) -> DataFrame:
    """t_df by the volatility percentile: thinner tails when calm; the middle one while fewer than ``least`` values are known."""
    df = F.when(F.col(pct).isNull(), mid).when(F.col(pct) < 0.25, low).when(F.col(pct) > 0.75, high).otherwise(mid)
    return frame.withColumn("t_df", F.when(F.col(seen) < least, mid).otherwise(df) if seen else df)


def path_table(spark, sigma: float, horizon: int, paths: int, seed: int = 42) -> DataFrame:
    """(path_id, step, log_price) of constant-volatility Gaussian paths, from built-in expressions; for inspection."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "path_id", "step", F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    z = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    rows = spark.range(paths).withColumnRenamed("id", "path_id").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("d", -sigma * sigma / 2 + sigma * z)
    from pyspark.sql import Window

    w = Window.partitionBy("path_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("path_id", "step", F.sum("d").over(w).alias("log_price"))
