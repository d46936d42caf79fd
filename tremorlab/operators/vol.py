"""Closed forms around conditional volatility: diagnostics, projection, term structure, blends, jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlab.operators.lookup import as_of, running_count


def persistence(alpha: Column, beta: Column, gamma: Column | None = None) -> Column:
    return alpha + beta + (F.coalesce(gamma, F.lit(0.0)) / 2 if gamma is not None else 0.0)


def diagnostics(params: DataFrame) -> DataFrame:
    """phi, half-life and unconditional variance of (omega, alpha, beta, gamma); null where not stationary."""
    phi = persistence(F.col("alpha"), F.col("beta"), F.col("gamma"))
    f = params.withColumn("phi", phi)
    ok = (F.col("phi") > 0) & (F.col("phi") < 1)
    return f.withColumn("half_life", F.when(ok, F.log(F.lit(0.5)) / F.log("phi"))).withColumn("var_unc", F.when(F.col("phi") < 1, F.col("omega") / (1 - F.col("phi"))))


def project(params: DataFrame, target: float = 0.98, anchor: str = "anchor_var") -> DataFrame:
    """Scales alpha, beta and gamma to persistence ``target`` where it is 1 or more and sets omega so that the variance is the anchor's."""
    phi = persistence(F.col("alpha"), F.col("beta"), F.col("gamma"))
    hit = phi >= 1
    f = params.withColumn("projected", hit).withColumn("_s", F.when(hit, F.lit(target) / phi).otherwise(1.0)).withColumn("_hit", hit)
    f = f.withColumn("omega", F.when(F.col("_hit"), F.col(anchor) * (1 - target)).otherwise(F.col("omega")))
    for c in ("alpha", "beta", "gamma"):
        f = f.withColumn(c, F.col(c) * F.col("_s"))
    return f.drop("_s", "_hit")


def term_structure(sigma: Column, sigma_unc: Column, phi: Column, horizon: Column) -> Column:
    """Root mean of the expected variances of days 1..h; sigma itself where phi is not below 1."""
    excess = (sigma * sigma - sigma_unc * sigma_unc) * phi * (1 - F.pow(phi, horizon)) / (1 - phi) / horizon
    return F.when((phi >= 1) | (phi <= 0), sigma).otherwise(F.sqrt(F.greatest(sigma_unc * sigma_unc + excess, F.lit(1e-16))))


def blend(a: Column, b: Column, w: Column | float) -> Column:
    """sqrt((1-w) a^2 + w b^2); the valid one where the other is null or not positive."""
    w = F.lit(w) if isinstance(w, float) else w
    return F.when(b.isNull() | (b <= 0), a).when(a.isNull() | (a <= 0), b).otherwise(F.sqrt((1 - w) * a * a + w * b * b))


def har_horizon(s1: Column, s5: Column, s22: Column, h: Column) -> Column:
    """Linear between the 1-, 5- and 22-day values, flat beyond."""
    return F.when(h <= 1, s1).when(h <= 5, s1 + (s5 - s1) * (h - 1) / 4.0).when(h <= 22, s5 + (s22 - s5) * (h - 5) / 17.0).otherwise(s22)


def jump_parameters(frame: DataFrame, sigma: str = "sigma_1d", n: int = 300, low: tuple = (1.0, -0.01, 0.03), high: tuple = (4.0, -0.04, 0.06)) -> DataFrame:
    """Jump intensity, mean and deviation between a calm and a stressed set by where sigma lies between the quartiles of its last n values."""
    w = Window.partitionBy("ticker").orderBy("dt").rowsBetween(-(n - 1), 0)
    q = F.percentile(sigma, F.array(F.lit(0.25), F.lit(0.75))).over(w)
    f = frame.withColumn("_q", q).withColumn("_n", F.count(sigma).over(w))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    x = F.when(F.col("_n") < 50, 0.5).when(hi - lo < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(sigma) - lo) / (hi - lo))))
    f = f.withColumn("_x", x)
    for name, a, b in zip(("jump_rate", "jump_mean", "jump_dev"), low, high):
        f = f.withColumn(name, F.lit(a) + (b - a) * F.col("_x"))
    return f.drop("_q", "_n", "_x")


def event_variance(frame: DataFrame, events: DataFrame, sigma: str = "sigma", most: int = 12, least: int = 4, scale: float = 1.0) -> DataFrame:
    """event_var: what the squared larger return around each of the last ``most`` past events exceeds sigma^2 by, on average; 0 below ``least`` of them.

    An event belongs to the first row at or after its date, so events between trading days count; the return into that row competes
    with the one out of it, the former winning ties, where the latter is known. No return counts for two events. Frames
    hold a few rows each: chosen returns are summed among themselves and the sums carried to the rows after them.
    """
    w = Window.partitionBy("ticker").orderBy("dt")
    seen = running_count(events)
    at = as_of(as_of(frame.withColumn("_d", F.col("dt")), seen, name="_now").withColumn("dt", F.date_sub("_d", 1)), seen, name="_day_before").withColumn("dt", F.col("_d"))
    count = lambda c: F.coalesce(F.col(c)["seen"], F.lit(0))
    f = at.withColumn("_n", count("_now")).withColumn("_n0", count("_day_before")).drop("_now", "_day_before", "_d")
    earlier = F.coalesce(F.lag("_n").over(w), F.lit(0))
    size = lambda c: F.coalesce(F.abs(c), F.lit(-1.0))
    f = f.withColumn("_event", F.col("_n") > earlier).withColumn("_open", F.col("_n0") > earlier)
    f = f.withColumns({"_r": size(F.col("ret")), "_r_before": size(F.lag("ret").over(w)), "_r_after": size(F.lead("ret").over(w)), "_event_before": F.coalesce(F.lag("_event").over(w), F.lit(False))})
    into, out_of = F.col("_event") & (F.col("_r") >= F.col("_r_after")), F.col("_event_before") & (F.col("_r") > F.col("_r_before"))
    f = f.withColumn("_chosen", (into | out_of) & (F.col("_r") >= 0)).withColumn("_now", (F.col("_open") | out_of) & (F.col("_r") >= 0)).withColumn("_sq", F.col("ret") * F.col("ret"))
    among = Window.partitionBy("ticker", "_chosen").orderBy("dt")
    last = lambda n: F.struct(F.sum("_sq").over(among.rowsBetween(1 - n, 0)).alias("s"), F.count("_sq").over(among.rowsBetween(1 - n, 0)).alias("n"))
    f = f.withColumn("_sums", F.when(F.col("_chosen"), F.struct(last(most).alias("all"), last(most - 1).alias("but_one"))))
    f = f.withColumn("_past", F.last("_sums", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    part = lambda kind, of: F.coalesce(F.col("_past")[kind][of], F.lit(0))
    total = F.when(F.col("_now"), F.col("_sq") + part("but_one", "s")).otherwise(part("all", "s"))
    n = F.when(F.col("_now"), part("but_one", "n") + 1).otherwise(part("all", "n"))
    var = F.when(n >= least, F.greatest(total / n - F.col(sigma) * F.col(sigma), F.lit(0.0)) * scale).otherwise(0.0)
    return f.withColumn("event_var", var).drop("_n", "_n0", "_event", "_open", "_r", "_r_before", "_r_after", "_event_before", "_chosen", "_now", "_sq", "_sums", "_past")


def add_event_variance(sigma: Column, var: Column, count: Column, horizon: Column, shrink: float = 1.0) -> Column:
    """Volatility with the variance of ``count`` scheduled events spread over the horizon."""
    return F.sqrt(sigma * sigma + var * count * shrink / horizon)
