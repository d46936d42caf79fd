"""Volatility fits that need an optimiser: GARCH(1,1), GJR, an ensemble, and HAR regressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlab.operators.features import har_features

WINDOW, MIN_WINDOW = 756, 252


def garch_variances(r2: np.ndarray, neg: np.ndarray, var: float, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean Gaussian negative log likelihood and next-step variance for arrays of parameters, with omega set by the sample variance."""
    phi = alpha + beta + gamma / 2
    omega = var * (1 - phi)
    h, nll = np.full(len(alpha), var), np.zeros(len(alpha))
    for x, s in zip(r2, neg):
        nll += np.log(h) + x / h
        h = np.maximum(omega + (alpha + gamma * s) * x + beta * h, 1e-12 * max(var, 1e-12))
    return nll / len(r2), h


def fit_garch(returns: np.ndarray, model: str = "garch") -> dict:
    """Quasi maximum likelihood by a zooming grid over (alpha, phi[, gamma]) with variance targeting.

    All grid points of a level run through the recursion together, so a level costs one pass over the
    window. Too short or degenerate windows fall back to an exponentially weighted variance.
    """
    r = np.asarray(returns, dtype=float)
    r = r[np.isfinite(r)]
    none = {"omega": None, "alpha": None, "beta": None, "gamma": None}
    var = float(np.mean(r * r)) if len(r) else 0.0
    if len(r) < MIN_WINDOW or var < 1e-16:
        return none | {"sigma_1d": ewma_sigma(r), "source": "ewma"}
    r2, neg = r * r, (r < 0).astype(float)
    a, f, g = (0.0, 0.5), (0.3, 0.9995), (0.0, 0.4) if model == "gjr" else (0.0, 0.0)
    best = None
    for level in range(5):
        ga, gf, gg = np.linspace(*a, 9), np.linspace(*f, 9), np.linspace(*g, 5 if model == "gjr" else 1)
        A, P, G = (x.ravel() for x in np.meshgrid(ga, gf, gg, indexing="ij"))
        B = P - A - G / 2
        ok = B >= 0
        A, P, G, B = A[ok], P[ok], G[ok], B[ok]
        nll, h = garch_variances(r2, neg, var, A, B, G)
        k = int(nll.argmin())
        if best is None or nll[k] < best[0]:
            best = (nll[k], A[k], B[k], G[k], h[k])
        zoom = lambda lo, hi, at: (max(lo, at - (hi - lo) / 6), min(hi, at + (hi - lo) / 6))
        a, f = zoom(*a, best[1]), zoom(*f, best[1] + best[2] + best[3] / 2)
        g = zoom(*g, best[3]) if model == "gjr" else g
    _, al, be, ga, h = best
    sigma = float(np.sqrt(h))
    if not 0 < sigma <= 1:
        return none | {"sigma_1d": ewma_sigma(r), "source": "ewma"}
    return {"sigma_1d": sigma, "omega": float(var * (1 - al - be - ga / 2)), "alpha": float(al), "beta": float(be), "gamma": float(ga), "source": model}


def fit_egarch(returns: np.ndarray) -> dict:
    """Log-variance model with sign effect by the same zooming grid; its mean log variance is the sample's."""
    r = np.asarray(returns, dtype=float)
    r = r[np.isfinite(r)]
    none = {"omega": None, "alpha": None, "beta": None, "gamma": None}
    var = float(np.mean(r * r)) if len(r) else 0.0
    if len(r) < MIN_WINDOW or var < 1e-16:
        return none | {"sigma_1d": ewma_sigma(r), "source": "ewma"}
    a, b, g, best, mean_abs = (0.0, 0.5), (0.5, 0.999), (-0.3, 0.3), None, np.sqrt(2 / np.pi)
    for _ in range(4):
        A, B, G = (x.ravel() for x in np.meshgrid(np.linspace(*a, 7), np.linspace(*b, 7), np.linspace(*g, 5), indexing="ij"))
        lh, nll = np.full(len(A), np.log(var)), np.zeros(len(A))
        for x in r:
            h = np.exp(lh)
            nll += lh + x * x / h
            z = x / np.sqrt(h)
            lh = np.clip((1 - B) * np.log(var) + B * lh + A * (np.abs(z) - mean_abs) + G * z, np.log(var) - 12, np.log(var) + 12)
        k = int(nll.argmin())
        if best is None or nll[k] < best[0]:
            best = (nll[k], A[k], B[k], G[k], lh[k])
        zoom = lambda lo, hi, at: (max(lo, at - (hi - lo) / 5), min(hi, at + (hi - lo) / 5))
        a, b, g = zoom(*a, best[1]), zoom(*b, best[2]), zoom(*g, best[3])
    sigma = float(np.exp(best[4] / 2))
    if not 0 < sigma <= 1:
        return none | {"sigma_1d": ewma_sigma(r), "source": "ewma"}
    return {"sigma_1d": sigma, "omega": float((1 - best[2]) * np.log(var)), "alpha": float(best[1]), "beta": float(best[2]), "gamma": float(best[3]), "source": "egarch"}


def residuals(returns: np.ndarray, fit: dict) -> np.ndarray | None:
    """Standardised residuals of a GARCH or GJR fit, null with fewer than 100."""
    r = np.asarray(returns, dtype=float)
    if fit["omega"] is None or fit["source"] == "egarch" or len(r) < 100:
        return None
    h, out = float(np.mean(r * r)), []
    for x in r:
        out.append(x / np.sqrt(h))
        h = fit["omega"] + (fit["alpha"] + fit["gamma"] * (x < 0)) * x * x + fit["beta"] * h
    return np.array(out)


def ewma_sigma(r: np.ndarray) -> float:
    """Exponentially weighted deviation with span min(252, n), at least 1e-8."""
    if not len(r):
        return 1e-8
    keep = 1 - 2 / (min(252, len(r)) + 1)
    w = keep ** np.arange(len(r) - 1, -1, -1)
    return float(max(np.sqrt((w * r * r).sum() / w.sum()), 1e-8))


FIT = "ticker string, idx int, sigma_1d double, omega double, alpha double, beta double, gamma double, source string"


def filtered(fit: dict, returns: np.ndarray) -> list[float]:
    """One-day volatilities after each further return, by the recursion of a GARCH or GJR fit; other fits keep theirs."""
    if fit["omega"] is None or fit["source"] not in ("garch", "gjr"):
        return [fit["sigma_1d"]] * len(returns)
    h, out = fit["sigma_1d"] ** 2, []
    for x in returns:
        h = max(fit["omega"] + (fit["alpha"] + fit["gamma"] * (x < 0)) * x * x + fit["beta"] * h, 1e-16)
        out.append(min(1.0, float(np.sqrt(h))))
    return out


def garch_series(rets: DataFrame, every: int = 21, model: str = "garch", start: int = MIN_WINDOW, chunk: int = 1024, daily: bool = False) -> DataFrame:
    """A fit at each ``every``-th row from ``start`` on, of the returns known there.

    With ``daily`` every row from the first fit on has the parameters of its latest fit and the volatility that these give after the
    returns since. Series are cut into overlapping stretches of ``chunk`` rows plus a window, so that one long series is
    fitted by many tasks, each holding a bounded number of rows.
    """
    first, last = F.floor(F.col("idx") / chunk), F.floor((F.col("idx") + WINDOW + every) / chunk)
    cut = rets.where("ret is not null").select("ticker", "idx", "ret", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("part"))

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        idx, ret = g["idx"].to_numpy(), g["ret"].to_numpy()
        out = []
        mine = idx // chunk == key[1]
        grid = mine & (idx % every == 0)
        if daily:  # the first rows of a stretch go by the last fit before it
            grid |= (idx < key[1] * chunk) & (idx > key[1] * chunk - every) & (idx % every == 0)
        for t in idx[grid & (idx >= start)]:
            seen = ret[(idx <= t) & (idx > t - WINDOW)]
            if model == "ensemble":
                fits = [fit_garch(seen, "garch"), fit_garch(seen, "gjr"), fit_egarch(seen)]
                one = fits[1] | {"sigma_1d": float(np.mean([f["sigma_1d"] for f in fits])), "source": "ensemble"}
            else:
                one = fit_garch(seen, model)
            if not daily:
                out.append({"ticker": key[0], "idx": int(t)} | one)
                continue
            after = (idx > t) & (idx < t + every)
            for i, sigma in zip([t, *idx[after]], [one["sigma_1d"], *filtered(one, ret[after])]):
                if i // chunk == key[1]:
                    out.append({"ticker": key[0], "idx": int(i)} | one | {"sigma_1d": sigma})
        return pd.DataFrame(out, columns=[c.split()[0] for c in FIT.split(", ")])

    return cut.groupBy("ticker", "part").applyInPandas(fit, FIT)


def carry_forward(frame: DataFrame, fits: DataFrame) -> DataFrame:
    """``frame`` with the columns of the latest fit at or before each row."""
    cols = [c for c in fits.columns if c not in ("ticker", "idx")]
    w = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    f = frame.join(fits, ["ticker", "idx"], "left").withColumn("_f", F.when(F.col("sigma_1d").isNotNull(), F.struct(*cols))).drop(*cols)
    return f.withColumn("_f", F.last("_f", ignorenulls=True).over(w)).select("*", "_f.*").drop("_f")


def ridge(xtx: np.ndarray, xty: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients with an unpenalised intercept in the first place."""
    p = penalty * np.eye(len(xtx))
    p[0, 0] = 0.0
    return np.linalg.solve(xtx + p, xty)


def har_rv(rets: DataFrame, penalty: float = 0.01, value: Column | None = None) -> DataFrame:
    """HAR coefficients and R^2 by ticker and target: normal equations are summed by Spark, 4 x 4 systems solved in a batch function.

    ``value`` is the daily variance, squared returns where it is not given; Parkinson's or a sum with the overnight gap's are others.
    """
    f = har_features(rets, value)
    x = ["one", "rv_1", "rv_5", "rv_22"]
    f = f.withColumn("one", F.lit(1.0)).select("ticker", *x, F.explode(F.array(*[F.struct(F.lit(h).alias("target"), F.col(f"target_{h}").alias("y")) for h in (1, 5, 22)])).alias("t")).select("ticker", *x, "t.*")
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for i, a in enumerate(x) for b in x[i:]] + [F.sum(F.col(a) * F.col("y")).alias(f"{a}__y") for a in x]
    g = f.groupBy("ticker", "target").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *sums).where("n >= 44")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                m = np.array([[r.get(f"{p}__{q}", r.get(f"{q}__{p}")) for q in x] for p in x])
                v = np.array([r[f"{p}__y"] for p in x])
                scale = np.sqrt(np.maximum(np.diag(m) / r["n"], 1e-300))
                w = ridge(m / np.outer(scale, scale), v / scale, penalty * r["n"] * 0.01) / scale
                sse = r["yy"] - 2 * w @ v + w @ m @ w
                sst = r["yy"] - v[0] ** 2 / r["n"]
                out.append((r["ticker"], int(r["target"]), int(r["n"]), *map(float, w), float(1 - sse / sst) if sst > 0 else 0.0))
            yield pd.DataFrame(out, columns=["ticker", "target", "n", "b0", "b1", "b5", "b22", "r2"])

    return g.mapInPandas(solve, "ticker string, target int, n long, b0 double, b1 double, b5 double, b22 double, r2 double")


def har_sigma(rets: DataFrame, coef: DataFrame) -> DataFrame:
    """Fitted volatility by row and target, within [1e-8, 1]."""
    f = har_features(rets).join(F.broadcast(coef), "ticker")
    v = F.col("b0") + F.col("b1") * F.col("rv_1") + F.col("b5") * F.col("rv_5") + F.col("b22") * F.col("rv_22")
    return f.select("ticker", "idx", "target", F.least(F.lit(1.0), F.sqrt(F.greatest(v, F.lit(1e-16)))).alias("sigma_har"))
