"""The full walk: features, volatility fit, simulation and online calibration as stages of one plan.

Only calibration is sequential. Fits run per stretch of a series, simulations per row, and the
calibrators once per (ticker, horizon). Parameters are refitted every ``refit_every`` rows and the volatility follows every
return in between. Nothing at a date reads a label that is not known by then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlab.operators import features as X
from tremorlab.operators import online, simulate, vol, volfit
from tremorlab.sources import store


@dataclass(frozen=True)
class WalkConfig:
    """What a walk needs; unknown keys of a mapping are ignored by ``of``."""

    model: str = "garch"
    refit_every: int = 63
    paths: int = 1000
    seed: int = 42
    t_df: float | None = 5.0
    jumps: bool = False
    kind: str = "multi"
    regime_tails: bool = False
    stationarity_target: float = 0.98
    start: int = 252
    tau_quantile: float = 0.8

    @classmethod
    def of(cls, values: dict) -> WalkConfig:
        known = cls.__dataclass_fields__
        out = cls(**{k: v for k, v in values.items() if k in known})
        if not (out.refit_every >= 1 and out.paths >= 100 and 0 < out.stationarity_target < 1 and out.kind in ("multi", "regime")):
            raise ValueError(f"bad configuration: {out}")
        return out


def forecasts(panel: DataFrame, cfg: WalkConfig, thresholds: DataFrame | None = None) -> DataFrame:
    """Rows (ticker, idx, horizon) with raw simulated probabilities, quantiles, features and labels."""
    s = X.regime(X.percentile_rank(X.vol_state(X.with_returns(panel))))
    if thresholds is None:
        thresholds = X.adaptive_thresholds(X.forward_returns(panel.select("ticker", "dt", "price")), cfg.tau_quantile)
    fits = volfit.garch_series(s, cfg.refit_every, cfg.model, cfg.start, daily=True).withColumn("anchor_var", F.col("sigma_1d") * F.col("sigma_1d"))
    fits = vol.project(fits, cfg.stationarity_target).drop("anchor_var")
    f = s.join(fits, ["ticker", "idx"], "left")
    if cfg.jumps:
        f = vol.jump_parameters(f, "vol_20")
    f = X.label_moves(X.forward_returns(f), thresholds)
    f = X.boost_flag(f).withColumn("boost", F.coalesce("boost", F.lit(False)))
    f = f.where((F.col("idx") >= cfg.start) & F.col("sigma_1d").isNotNull())
    keep = ["ticker", "idx", "dt", "horizon", "ret_h", "tau", "y", "boost", "regime", "source", "projected", "sigma_1d", "omega", "alpha", "beta", "gamma", *online.FEATURES]
    keep += [c for c in ("jump_rate", "jump_mean", "jump_dev") if cfg.jumps]
    if cfg.regime_tails:
        f = simulate.regime_df(f)
        keep.append("t_df")
    return simulate.simulate(f.select(*keep), cfg.paths, cfg.seed, cfg.t_df, boost="boost")


def walk_forward(panel: DataFrame, cfg: WalkConfig | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """Forecasts with p_cal from the online calibrators."""
    cfg = cfg or WalkConfig()
    raw = forecasts(panel, cfg, thresholds)
    # written once: the calibrators read it and their result joins it
    at = f"{store.work_dir(raw.sparkSession, 'walk')}/raw"
    raw.write.parquet(at)
    raw = raw.sparkSession.read.schema(raw.schema).parquet(at)
    cal = online.calibrate(raw.withColumn("p", F.greatest(F.lit(0.001), F.least(F.lit(0.999), "p_raw"))), cfg.kind)
    return raw.join(cal.select("ticker", "idx", "horizon", "p_cal"), ["ticker", "idx", "horizon"])
