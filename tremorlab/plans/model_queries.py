"""Lookup, volatility and baseline probability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlab.functions import scalar
from tremorlab.operators import baselines as L
from tremorlab.operators import features as X
from tremorlab.operators import lookup as J
from tremorlab.operators import vol as V
from tremorlab.plans.base import R, panel, rets, scored, state
from tremorlab.plans.registry import cte, query, r6
from tremorlab.sources import panel as P

cte("iv", """SELECT dt, CASE WHEN n % 2 = 0 THEN x / 1e6 END AS iv_9d, x / 9e5 AS iv_30d, CASE WHEN n % 3 > 0 THEN x / 8e5 END AS iv_3m FROM
 (SELECT CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS x, count(*) AS n FROM orders GROUP BY 1) WHERE date_diff('day', DATE '1995-01-01', dt) % 3 = 0""")
cte("events_cal", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS event_dt FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)")
WD = "(SELECT count(*) FROM range(i.dt, p.dt, INTERVAL 1 DAY) d(x) WHERE isodow(x) <= 5)"
cte("with_iv", f"SELECT p.ticker, p.idx, p.dt, CASE WHEN {WD} <= 5 THEN iv_9d END AS iv_9d, CASE WHEN {WD} <= 5 THEN iv_30d END AS iv_30d, CASE WHEN {WD} <= 5 THEN iv_3m END AS iv_3m FROM panel p ASOF LEFT JOIN iv i ON p.dt >= i.dt")


@query(f"SELECT ticker, idx, {r6('iv_9d')} AS iv_9d, {r6('iv_30d')} AS iv_30d FROM (SELECT p.ticker, p.idx, i.iv_9d, i.iv_30d FROM panel p ASOF LEFT JOIN iv i ON p.dt >= i.dt)")
def asof_iv(spark, d):
    f = J.as_of(panel(spark, d), P.implied_vol_from_orders(spark, d))
    return f.select("ticker", "idx", R(F.col("found")["iv_9d"], "iv_9d"), R(F.col("found")["iv_30d"], "iv_30d"))


@query(f"""SELECT ticker, idx, horizon, {r6('''CASE WHEN horizon <= 9 THEN coalesce(iv_9d, iv_30d) WHEN horizon < 30 THEN CASE WHEN iv_9d IS NULL OR iv_30d IS NULL THEN coalesce(iv_30d, iv_9d)
 ELSE iv_9d + (iv_30d - iv_9d) * (horizon - 9) / 21.0 END ELSE coalesce(iv_3m, iv_30d) END''')} AS iv_vol FROM (SELECT *, unnest([5, 10, 30]) AS horizon FROM with_iv)""")
def iv_tenor_interp(spark, d):
    f = panel(spark, d).withColumn("horizon", F.explode(F.array(F.lit(5), F.lit(10), F.lit(30))))
    return J.implied_vol(f, P.implied_vol_from_orders(spark, d)).select("ticker", "idx", "horizon", R("iv_vol", "iv_vol"))


@query(f"""SELECT ticker, idx, {r6('greatest(0.0, 1 - n / 20.0)')} AS proximity FROM (SELECT ticker, idx, coalesce((SELECT min(abs(date_diff('day', event_dt, p.dt))) FROM events_cal), 1000000) AS n FROM panel p)""")
def nearest_event_proximity(spark, d):
    return J.nearest_event(panel(spark, d), P.event_calendar(spark, d)).select("ticker", "idx", R("proximity", "proximity"))


cte("event_counts", """SELECT ticker, idx, (SELECT count(*) FROM events_cal WHERE event_dt BETWEEN p.dt AND p.e) AS n_events FROM
 (SELECT *, coalesce(lead(dt, 10) OVER (PARTITION BY ticker ORDER BY dt), max(dt) OVER (PARTITION BY ticker)) AS e FROM panel) p""")


@query("SELECT ticker, idx, n_events FROM event_counts")
def event_count_in_horizon(spark, d):
    return J.event_count(panel(spark, d), P.event_calendar(spark, d), 10).select("ticker", "idx", "n_events")


@query(f"""SELECT f.ticker, f.idx, f.horizon, CAST(t.dt AS DATE) AS resolved_dt, {r6('t.price / f.price - 1')} AS realized_return FROM (SELECT *, unnest([5, 10]) AS horizon FROM panel) f
 JOIN panel t ON t.ticker = f.ticker AND t.idx = f.idx + f.horizon""")
def resolution_join(spark, d):
    p = panel(spark, d)
    f = p.select("ticker", "dt", F.explode(F.array(F.lit(5), F.lit(10))).alias("horizon"))
    return J.resolve_by_position(f, p).select("ticker", "idx", "horizon", "resolved_dt", R("realized_return", "realized_return"))


@query("SELECT ticker, idx, CAST(lead(dt, 10) OVER (PARTITION BY ticker ORDER BY dt) AS DATE) AS resolves FROM panel")
def calendar_lookup(spark, d):
    return J.resolution_date(panel(spark, d), 10).select("ticker", "idx", "resolves")


cte("params", "SELECT p_partkey AS k, 1e-6 * p_size AS omega, 0.02 + (p_partkey % 10) * 0.01 AS alpha, 0.80 + (p_partkey % 13) * 0.015 AS beta, (p_partkey % 4) * 0.02 AS gamma, 1e-4 * p_size AS anchor_var FROM part")
cte("params_phi", "SELECT *, alpha + beta + gamma / 2 AS phi FROM params")


def _params(spark, d):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("k"), (1e-6 * F.col("p_size")).alias("omega"), (0.02 + k % 10 * 0.01).alias("alpha"), (0.80 + k % 13 * 0.015).alias("beta"), (k % 4 * 0.02).alias("gamma"), (1e-4 * F.col("p_size")).alias("anchor_var"))


@query(f"SELECT k, {r6('phi')} AS phi, {r6('CASE WHEN phi > 0 AND phi < 0.9999999 THEN ln(0.5) / ln(phi) END')} AS half_life, {r6('CASE WHEN phi < 0.9999999 THEN 1000 * omega / (1 - phi) END')} AS var_unc FROM params_phi WHERE abs(phi - 1) > 1e-9")
def garch_diagnostics(spark, d):
    return V.diagnostics(_params(spark, d)).where(F.abs(F.col("phi") - 1) > 1e-9).select("k", R("phi", "phi"), R("half_life", "half_life"), R(1000 * F.col("var_unc"), "var_unc"))


@query(f"""SELECT k, phi >= 1 AS projected, {r6('CASE WHEN phi >= 1 THEN anchor_var * (1 - 0.98) ELSE omega END')} AS omega, {r6('alpha * CASE WHEN phi >= 1 THEN 0.98 / phi ELSE 1 END')} AS alpha,
 {r6('beta * CASE WHEN phi >= 1 THEN 0.98 / phi ELSE 1 END')} AS beta FROM params_phi WHERE abs(phi - 1) > 1e-9""")
def stationarity_projection(spark, d):
    f = _params(spark, d).where(F.abs(V.persistence(F.col("alpha"), F.col("beta"), F.col("gamma")) - 1) > 1e-9)
    return V.project(f).select("k", "projected", R("omega", "omega"), R("alpha", "alpha"), R("beta", "beta"))


@query(f"""SELECT ticker, idx, horizon, {r6('sqrt(greatest(sigma * sigma + (vol_20 * vol_20 - sigma * sigma) * 0.95 * (1 - pow(0.95, horizon)) / 0.05 / horizon, 1e-16))')} AS sigma_h FROM ahead WHERE vol_20 IS NOT NULL""")
def term_structure_sigma(spark, d):
    f = X.forward_returns(X.vol_state(rets(spark, d))).where("vol_20 is not null")
    phi = F.lit(0.95)
    excess_safe = V.term_structure(F.col("vol_20"), F.col("sigma"), phi, F.col("horizon"))
    return f.select("ticker", "idx", "horizon", R(excess_safe, "sigma_h"))


@query(f"""SELECT ticker, idx, {r6('CASE WHEN rs IS NULL OR rs <= 0 THEN vol_20 WHEN vol_20 IS NULL OR vol_20 <= 0 THEN rs ELSE sqrt(0.7 * vol_20 * vol_20 + 0.3 * rs * rs) END')} AS sigma_blend FROM
 (SELECT *, sqrt(avg(pow(ln(high / low), 2) / (4 * ln(2.0))) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS rs FROM vol20)""")
def blend_variance(spark, d):
    f = X.range_features(X.vol_state(rets(spark, d)))
    return f.select("ticker", "idx", R(V.blend(F.col("vol_20"), F.col("range_sigma"), 0.3), "sigma_blend"))


@query(f"""SELECT ticker, idx, {r6('1 + 3 * x')} AS jump_rate, {r6('-0.01 - 0.03 * x')} AS jump_mean, {r6('0.03 + 0.03 * x')} AS jump_dev FROM (SELECT ticker, idx,
 CASE WHEN n < 50 THEN 0.5 WHEN hi - lo < 1e-12 THEN 0.0 ELSE greatest(0.0, least(1.0, (vol_20 - lo) / (hi - lo))) END AS x FROM (SELECT *, count(vol_20) OVER w AS n, quantile_cont(vol_20, 0.25) OVER w AS lo, quantile_cont(vol_20, 0.75) OVER w AS hi FROM vol20
 WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)))""")
def jump_state_interp(spark, d):
    f = V.jump_parameters(X.vol_state(rets(spark, d)), "vol_20")
    return f.select("ticker", "idx", R("jump_rate", "jump_rate"), R("jump_mean", "jump_mean"), R("jump_dev", "jump_dev"))


# every event is placed for every later row, then the last 12 distinct returns are kept
cte("event_pos", "SELECT ticker, event_dt, min(idx) AS pos FROM panel JOIN events_cal ON dt >= event_dt GROUP BY ALL")
cte(
    "event_used",
    """SELECT DISTINCT t.ticker, t.idx, CASE WHEN e.pos + 1 <= t.idx AND abs(b.ret) > coalesce(abs(a.ret), -1) THEN b.idx ELSE a.idx END AS used, CASE WHEN e.pos + 1 <= t.idx AND abs(b.ret) > coalesce(abs(a.ret), -1) THEN b.ret ELSE a.ret END AS r
 FROM rets t JOIN event_pos e ON e.ticker = t.ticker AND e.event_dt < t.dt JOIN rets a ON a.ticker = e.ticker AND a.idx = e.pos LEFT JOIN rets b ON b.ticker = e.ticker AND b.idx = e.pos + 1""",
)
cte("event_last", "SELECT ticker, idx, avg(r * r) AS v, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ticker, idx ORDER BY used DESC) AS k FROM event_used WHERE r IS NOT NULL) WHERE k <= 12 GROUP BY ALL")
cte("event_var", "SELECT v.ticker, v.idx, CASE WHEN e.n >= 4 THEN coalesce(greatest(e.v - v.sigma * v.sigma, 0.0), 0.0) ELSE 0.0 END AS event_var FROM vol20 v LEFT JOIN event_last e ON e.ticker = v.ticker AND e.idx = v.idx")


@query(f"SELECT ticker, idx, {r6('event_var')} AS event_var FROM event_var")
def scheduled_event_variance(spark, d):
    f = V.event_variance(X.vol_state(rets(spark, d)), P.event_calendar(spark, d))
    return f.select("ticker", "idx", R(F.coalesce("event_var", F.lit(0.0)), "event_var"))


@query(f"SELECT ticker, idx, {r6('sqrt(sigma * sigma + event_var * n_events / 10)')} AS sigma_event FROM vol20 JOIN event_var USING (ticker, idx) JOIN event_counts USING (ticker, idx)")
def event_variance_sigma(spark, d):
    ev = P.event_calendar(spark, d)
    f = J.event_count(V.event_variance(X.vol_state(rets(spark, d)), ev), ev, 10)
    return f.select("ticker", "idx", R(V.add_event_variance(F.col("sigma"), F.col("event_var"), F.col("n_events"), F.lit(10)), "sigma_event"))


@query(f"SELECT ticker, idx, horizon, {r6('p')} AS p FROM scored")
def normal_cdf_prob(spark, d):
    return scored(spark, d).select("ticker", "idx", "horizon", R("p", "p"))


@query(f"SELECT ticker, idx, {r6(scalar.norm_cdf_sql('(ret / 0.2)'))} AS cdf FROM rets WHERE ret IS NOT NULL")
def normal_cdf(spark, d):
    return rets(spark, d).where("ret is not null").select("ticker", "idx", R(scalar.norm_cdf(F.col("ret") / 0.2), "cdf"))


TH = "atan(ret / 0.2 / sqrt(5.0))"


@query(f"SELECT ticker, idx, {r6(f'0.5 + ({TH} + sin({TH}) * (cos({TH}) + 2.0::DOUBLE / 3.0::DOUBLE * pow(cos({TH}), 3))) / pi()')} AS cdf FROM rets WHERE ret IS NOT NULL")
def student_t5_cdf(spark, d):
    return rets(spark, d).where("ret is not null").select("ticker", "idx", R(scalar.t_cdf_5(F.col("ret") / 0.2), "cdf"))


cte("iv_scored", "SELECT s.ticker, s.idx, s.horizon, s.tau, s.y, s.base, i.iv_30d AS iv FROM scored s ASOF LEFT JOIN (SELECT dt, iv_30d FROM iv WHERE iv_30d IS NOT NULL) i ON s.dt >= i.dt")
SQH = "(iv * sqrt(horizon / 252.0))"


@query(f"""SELECT ticker, idx, horizon, {r6(f"greatest(0.001, least(0.999, {scalar.norm_cdf_sql(f'((ln(1 - tau) + 0.5 * {SQH} * {SQH}) / {SQH})')} + 1 - {scalar.norm_cdf_sql(f'((ln(1 + tau) + 0.5 * {SQH} * {SQH}) / {SQH})')}))")} AS p FROM iv_scored WHERE iv IS NOT NULL""")
def market_implied_prob(spark, d):
    return L.market_implied(L.with_iv(scored(spark, d), P.implied_vol_from_orders(spark, d))).select("ticker", "idx", "horizon", R("p", "p"))


@query(f"SELECT ticker, idx, horizon, {r6(f'greatest(0.0, least(1.0, 2 * (1 - ' + scalar.norm_cdf_sql(f'(tau / {SQH})') + ')))')} AS p FROM iv_scored WHERE iv IS NOT NULL")
def implied_vol_prob(spark, d):
    return L.implied_vol(L.with_iv(scored(spark, d), P.implied_vol_from_orders(spark, d))).select("ticker", "idx", "horizon", R("p", "p"))


@query(f"""SELECT ticker, idx, horizon, {r6('greatest(0.001, least(0.999, CASE WHEN n < 63 THEN base WHEN vol_20 > q THEN least(base * 1.5, 0.95) ELSE greatest(base / 1.5, 0.005) END))')} AS p FROM (SELECT *, count(vol_20) OVER w AS n, quantile_cont(vol_20, 0.8) OVER w AS q FROM scored
 WINDOW w AS (PARTITION BY ticker, horizon ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))""")
def vix_rule(spark, d):
    return L.vol_rule(scored(spark, d), "vol_20").select("ticker", "idx", "horizon", R("p", "p"))
