"""Predictions for the latest day of each series from saved calibrator states."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlab.operators import features as X
from tremorlab.operators import online, simulate, volfit


def latest_fits(recent: DataFrame, model: str) -> DataFrame:
    """One fit for each series of (ticker, idx, ret), which has at most a window of rows a series."""

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        one = {"ticker": key[0], "idx": int(g["idx"].iloc[-1])} | volfit.fit_garch(g["ret"].to_numpy(), model)
        return pd.DataFrame([one], columns=[c.split()[0] for c in volfit.FIT.split(", ")])

    return recent.select("ticker", "idx", "ret").groupBy("ticker").applyInPandas(fit, volfit.FIT)


def predict_latest(panel: DataFrame, states: DataFrame, thresholds: DataFrame, paths: int = 10_000, seed: int = 42, model: str = "gjr", df: float | None = None) -> DataFrame:
    """(ticker, dt, horizon, tau, sigma_1d, p_raw, se, ci_low, ci_high, p_cal, n_updates, hist_rate) for the last row of each series.

    ``states`` has (ticker, horizon, state) as ``online.train_states`` gives them, ``thresholds`` (horizon, tau). The volatility is
    fitted anew on the last window, the probability simulated and clipped to [0.001, 0.999], then calibrated without
    learning anything. hist_rate is the share of moves among the last 252 known outcomes. Series without a state get no row.
    """
    s = X.vol_state(X.with_returns(panel))
    back = Window.partitionBy("ticker").orderBy(F.col("dt").desc())
    recent = s.withColumn("_k", F.row_number().over(back)).where(F.col("_k") <= volfit.WINDOW)
    now = recent.where("_k = 1").drop("_k").join(latest_fits(recent, model).drop("idx"), "ticker")
    now = now.join(states, "ticker").join(F.broadcast(thresholds), "horizon")
    base = X.rolling_base_rate(X.label_moves(X.forward_returns(panel), thresholds)).select("ticker", "idx", "horizon", F.col("base").alias("hist_rate"))
    now = now.join(base, ["ticker", "idx", "horizon"], "left")
    cols = ["ticker", "idx", "dt", "horizon", "tau", "sigma_1d", "omega", "alpha", "beta", "gamma", *online.FEATURES, "state", "hist_rate"]
    raw = simulate.simulate(now.select(*cols), paths, seed, df).withColumn("p_raw", F.greatest(F.lit(0.001), F.least(F.lit(0.999), "p_raw")))
    out = raw.select("ticker", "dt", "horizon", "tau", "sigma_1d", "p_raw", "se", "ci_low", "ci_high", "hist_rate", "state", *online.FEATURES)
    kept = ["ticker", "dt", "horizon", "tau", "sigma_1d", "p_raw", "se", "ci_low", "ci_high", "hist_rate"]

    def calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            states_of = [json.loads(x) for x in b["state"]]
            feats = b[list(online.FEATURES)].astype(float).to_numpy()
            known = b["p_raw"].notna()
            p = [online.emit(t, q, list(x)) if ok else None for t, q, x, ok in zip(states_of, b["p_raw"], feats, known)]
            yield b[kept].assign(p_cal=p, n_updates=[sum(m["n"] for m in t["models"]) for t in states_of])

    kinds = ", ".join(f"{c} {out.schema[c].dataType.simpleString()}" for c in kept)
    return out.mapInPandas(calibrate, f"{kinds}, p_cal double, n_updates long")
