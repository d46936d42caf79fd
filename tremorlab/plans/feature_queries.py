"""Panel, data quality and window feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlab.functions import scalar
from tremorlab.operators import features as X
from tremorlab.operators import quality as Q
from tremorlab.plans.base import R, labelled, panel, rets, state
from tremorlab.plans.registry import query, r6
from tremorlab.sources import panel as P

BD = "(SELECT CAST(count(*) AS INTEGER) FROM range({a}, {b}, INTERVAL 1 DAY) d(x) WHERE isodow(x) <= 5)"


@query(f"SELECT ticker, dt, idx, {r6('price')} AS price, {r6('high')} AS high, {r6('low')} AS low, {r6('volume')} AS volume FROM panel")
def panel_bars(spark, d):
    return panel(spark, d).select("ticker", "dt", "idx", R("price", "price"), R("high", "high"), R("low", "low"), R("volume", "volume"))


@query(f"SELECT ticker, dt, idx, {r6('price')} AS price FROM panel2")
def panel_bars_orders(spark, d):
    return P.from_orders(spark, d).select("ticker", "dt", "idx", R("price", "price"))


@query(f"SELECT ticker, idx, {r6('ret')} AS ret FROM rets")
def returns_simple(spark, d):
    return rets(spark, d).select("ticker", "idx", R("ret", "ret"))


@query(f"SELECT ticker, idx, {r6('log_ret')} AS log_ret, {r6('ln(lead(price, 5) OVER (PARTITION BY ticker ORDER BY dt) / price)')} AS ahead_5 FROM rets")
def returns_log(spark, d):
    return rets(spark, d).select("ticker", "idx", R("log_ret", "log_ret"), R(F.log(F.lead("price", 5).over(X.W()) / F.col("price")), "ahead_5"))


@query(f"SELECT ticker, idx, horizon, {r6('ret_h')} AS ret_h, y FROM labelled")
def forward_labels(spark, d):
    return labelled(spark, d).select("ticker", "idx", "horizon", R("ret_h", "ret_h"), "y")


@query(f"SELECT ticker, horizon, count(y) AS n, {r6('avg(y)')} AS rate FROM labelled GROUP BY ALL")
def label_event_rate(spark, d):
    return labelled(spark, d).groupBy("ticker", "horizon").agg(F.count("y").alias("n"), R(F.avg("y"), "rate"))


@query("SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL")
def dedupe_keep_first(spark, d):
    return Q.keep_first(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], ["l_extendedprice"]).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))


@query(f"""SELECT ticker, idx, {r6('ret')} AS ret FROM rets JOIN (SELECT ticker, quantile_cont(ret, 0.25) q1, quantile_cont(ret, 0.75) q3 FROM rets GROUP BY ticker) USING (ticker)
WHERE ret < q1 - 1.0 * (q3 - q1) OR ret > q3 + 1.0 * (q3 - q1)""")
def dq_outliers_iqr(spark, d):
    return Q.iqr_outliers(rets(spark, d), 1.0).select("ticker", "idx", R("ret", "ret"))


@query("""SELECT ticker, CAST(min(idx) AS INTEGER) AS start_idx, CAST(least(max(idx) + 1, max(m)) AS INTEGER) AS last_idx, count(*) - 1 AS n FROM (
 SELECT ticker, idx, flat, max(idx) OVER (PARTITION BY ticker) AS m, sum(1 - flat) OVER (PARTITION BY ticker ORDER BY dt) AS island FROM (
  SELECT *, CASE WHEN abs(p - lag(p) OVER (PARTITION BY ticker ORDER BY dt)) < 1e-10 THEN 1 ELSE 0 END AS flat FROM (SELECT ticker, dt, idx, floor(price / 20000) AS p FROM panel)))
GROUP BY ticker, island HAVING count(*) > 3""")
def dq_stale_runs(spark, d):
    coarse = panel(spark, d).withColumn("price", F.floor(F.col("price") / 20000).cast("double"))
    return Q.stale_runs(coarse, 3).select("ticker", "start_idx", "last_idx", "n")


@query(f"""SELECT ticker, dt, gap FROM (SELECT ticker, dt, {BD.format(a='lag_dt', b='dt')} AS gap FROM (SELECT ticker, dt, lag(dt) OVER (PARTITION BY ticker ORDER BY dt) AS lag_dt FROM panel2)) WHERE gap > 1""")
def dq_gaps(spark, d):
    return Q.date_gaps(P.from_orders(spark, d), 1).select("ticker", "dt", "gap")


@query(f"""SELECT ticker, idx, {r6('err')} AS err FROM (SELECT ticker, idx, list_min(list_transform([2, 3, 4, 5, 10, 1/2, 1/3, 1/4, 1/5, 1/10], lambda k: abs((1 + ret) - k) / k)) AS err FROM rets) WHERE err <= 0.08""")
def dq_split_like(spark, d):
    return Q.split_like(rets(spark, d)).select("ticker", "idx", R("err", "err"))


@query("""SELECT ticker, idx FROM (SELECT *, 1e-10 * greatest(abs(high), abs(low), abs(price), abs(open), 1) AS tol FROM (SELECT ticker, idx, price, open, low, CASE WHEN idx % 50 = 0 THEN low * 0.9 ELSE high END AS high FROM panel))
WHERE high + tol < greatest(open, price, low) OR low - tol > least(open, price, high)""")
def dq_ohlc(spark, d):
    bent = panel(spark, d).withColumn("high", F.when(F.col("idx") % 50 == 0, F.col("low") * 0.9).otherwise(F.col("high")))
    return Q.ohlc_breaks(bent).select("ticker", "idx")


MOMENTS = "count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s"


@query(f"""SELECT ticker, {r6('n / ((n - 1) * (n - 2)) * sum(pow((ret - m) / s, 3))')} AS skew,
 {r6('(n * (n + 1)) / ((n - 1) * (n - 2) * (n - 3)) * sum(pow((ret - m) / s, 4)) - 3 * pow(n - 1, 2) / ((n - 2) * (n - 3))')} AS kurt
FROM (SELECT ticker, ret FROM rets WHERE ret IS NOT NULL) JOIN (SELECT ticker, CAST(count(ret) AS DOUBLE) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM rets GROUP BY ticker) USING (ticker) GROUP BY ticker, n, m, s""")
def dq_skew_kurt(spark, d):
    return Q.skew_kurt(rets(spark, d), "ret", ["ticker"]).select("ticker", R("skew", "skew"), R("kurt", "kurt"))


@query(f"SELECT ticker, 'gap' AS issue, count(*) AS n FROM (SELECT ticker, {BD.format(a='lag_dt', b='dt')} AS gap FROM (SELECT ticker, dt, lag(dt) OVER (PARTITION BY ticker ORDER BY dt) AS lag_dt FROM panel)) WHERE gap > 5 GROUP BY 1 UNION ALL SELECT ticker, 'outlier', count(*) AS n FROM rets JOIN (SELECT ticker, quantile_cont(ret, 0.25) q1, quantile_cont(ret, 0.75) q3 FROM rets GROUP BY ticker) USING (ticker) WHERE ret < q1 - 5 * (q3 - q1) OR ret > q3 + 5 * (q3 - q1) GROUP BY 1 UNION ALL SELECT ticker, 'split_like', count(*) FROM (SELECT ticker, list_min(list_transform([2, 3, 4, 5, 10, 1/2, 1/3, 1/4, 1/5, 1/10], lambda k: abs((1 + ret) - k) / k)) AS err FROM rets) WHERE err <= 0.08 GROUP BY 1")
def dq_report(spark, d):
    return Q.report(panel(spark, d)).select("ticker", "issue", "n")


def _vol(name, column, sql, source="vstate"):
    def run(spark, d):
        return X.vol_state(rets(spark, d)).select("ticker", "idx", R(column, column))

    run.__name__ = name
    query(f"SELECT ticker, idx, {r6(sql)} AS {column} FROM {source}")(run)


for _n, _c in (("realized_vol_20", "vol_20"), ("vol_ratio", "vol_ratio"), ("delta_sigma_20", "delta_sigma"), ("vol_of_vol_60", "vol_of_vol"), ("expanding_sigma", "sigma")):
    _vol(_n, _c, _c)


@query(f"SELECT ticker, idx, {r6('pct')} AS pct FROM vpct")
def rolling_pct_rank(spark, d):
    return X.percentile_rank(X.vol_state(rets(spark, d))).select("ticker", "idx", R("pct", "pct"))


@query("SELECT ticker, idx, regime, CASE WHEN known < 50 THEN 0 ELSE coalesce(CAST(least(floor(pct * 3), 2) AS INTEGER), 0) END AS regime_bin FROM state")
def regime_route(spark, d):
    return X.regime_bin(state(spark, d)).select("ticker", "idx", "regime", "regime_bin")


GATED = "(SELECT *, CASE WHEN horizon = 5 THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS thr_fixed, 2.0 * sigma * sqrt(horizon) AS thr_anchored FROM ahead)"


@query(f"SELECT ticker, idx, horizon, {r6('thr_fixed')} AS thr_fixed FROM {GATED}")
def threshold_fixed(spark, d):
    return X.gated_threshold(X.forward_returns(state(spark, d))).select("ticker", "idx", "horizon", R("thr_fixed", "thr_fixed"))


@query(f"SELECT ticker, idx, horizon, {r6('thr_anchored')} AS thr_anchored, {r6(chr(67) + chr(65) + 'SE WHEN regime = ' + repr('high') + ' THEN thr_anchored ELSE thr_fixed END')} AS thr FROM {GATED}")
def threshold_anchored(spark, d):
    return X.gated_threshold(X.forward_returns(state(spark, d))).select("ticker", "idx", "horizon", R("thr_anchored", "thr_anchored"), R("thr", "thr"))


RANGE = """(SELECT *, pow(ln(high / low), 2) / (4 * ln(2.0)) AS parkinson, ln(open / lag(price) OVER (PARTITION BY ticker ORDER BY dt)) AS g, ln(high / low) AS intraday FROM panel)"""


@query(f"SELECT ticker, idx, {r6('parkinson')} AS parkinson, {r6('intraday')} AS intraday FROM {RANGE}")
def parkinson_var(spark, d):
    return X.range_features(panel(spark, d)).select("ticker", "idx", R("parkinson", "parkinson"), R("intraday", "intraday"))


@query(f"SELECT ticker, idx, {r6('sqrt(avg(parkinson) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))')} AS range_sigma FROM {RANGE}")
def range_sigma_20(spark, d):
    return X.range_features(panel(spark, d)).select("ticker", "idx", R("range_sigma", "range_sigma"))


@query(f"SELECT ticker, idx, {r6('abs(g)')} AS gap, {r6('g * g')} AS gap_var FROM {RANGE}")
def overnight_gap(spark, d):
    return X.range_features(panel(spark, d)).select("ticker", "idx", R("gap", "gap"), R("gap_var", "gap_var"))


@query(f"SELECT ticker, idx, {r6('avg(ret * ret) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)')} AS rv FROM rets")
def realized_variance(spark, d):
    return X.rolling_mean(rets(spark, d), F.col("ret") * F.col("ret"), 22, "rv").select("ticker", "idx", R("rv", "rv"))


@query(f"""SELECT a.ticker, a.idx, {r6('sqrt(greatest(sum(b.ret * b.ret * w) / sum(w), 1e-16))')} AS ewma FROM panel a JOIN (SELECT * FROM rets WHERE ret IS NOT NULL) b ON a.ticker = b.ticker AND b.idx <= a.idx,
LATERAL (SELECT pow(1 - 2.0 / 21, a.idx - b.idx) AS w) GROUP BY 1, 2 UNION ALL SELECT ticker, idx, NULL FROM panel WHERE idx = 0""")
def ewma_vol(spark, d):
    return X.ewma_vol(rets(spark, d)).select("ticker", "idx", R("ewma", "ewma"))


@query(f"""SELECT ticker, idx, {r6('rv_5')} AS rv_5, {r6('rv_22')} AS rv_22, {r6('t5')} AS target_5, {r6('t22')} AS target_22 FROM (
SELECT *, avg(ret * ret) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rv_5, avg(ret * ret) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS rv_22,
avg(ret * ret) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS t5, avg(ret * ret) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 22 FOLLOWING) AS t22,
count(ret) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 22 FOLLOWING) AS n FROM rets) WHERE idx >= 22 AND n = 22""")
def har_features(spark, d):
    return X.har_features(rets(spark, d)).select("ticker", "idx", R("rv_5", "rv_5"), R("rv_22", "rv_22"), R("target_5", "target_5"), R("target_22", "target_22"))


@query(f"SELECT ticker, idx, horizon, {r6('base')} AS base FROM based")
def base_rate_252(spark, d):
    return X.rolling_base_rate(labelled(spark, d)).select("ticker", "idx", "horizon", R("base", "base"))


@query("""SELECT ticker, idx, horizon, CASE WHEN horizon = 5 THEN count(y) OVER a = 252 AND avg(y) OVER a < 0.2 ELSE count(y) OVER b = 252 AND avg(y) OVER b < 0.2 END AS boost FROM labelled
WINDOW a AS (PARTITION BY ticker, horizon ORDER BY dt ROWS BETWEEN 256 PRECEDING AND 5 PRECEDING), b AS (PARTITION BY ticker, horizon ORDER BY dt ROWS BETWEEN 261 PRECEDING AND 10 PRECEDING)""")
def boost_flag(spark, d):
    return X.boost_flag(labelled(spark, d), 0.2).select("ticker", "idx", "horizon", F.coalesce("boost", F.lit(False)).alias("boost"))


@query(f"""SELECT ticker, idx, {r6('CASE WHEN count(ret) OVER l40 = 40 THEN stddev_pop(ret) OVER l40 END')} AS vol_40, {r6('abs(price / lag(price, 5) OVER (PARTITION BY ticker ORDER BY dt) - 1)')} AS abs_ret_5,
{r6('CASE WHEN len(v) = 12 THEN list_stddev_pop(v) END')} AS vov_strided FROM (SELECT *, list_filter([{', '.join(f'lag(vol_20, {5 * k}) OVER (PARTITION BY ticker ORDER BY dt)' for k in range(12))}], lambda x: x IS NOT NULL) AS v FROM vol20)
WINDOW l40 AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)""")
def strided_features(spark, d):
    return X.strided_features(rets(spark, d)).select("ticker", "idx", R("vol_40", "vol_40"), R("abs_ret_5", "abs_ret_5"), R("vov_strided", "vov_strided"))


@query("SELECT ticker, CASE WHEN dt <= DATE '2020-02-19' THEN 'pre_covid' WHEN dt <= DATE '2020-12-31' THEN 'covid' WHEN dt <= DATE '2022-12-31' THEN 'post_covid' ELSE 'recent' END AS era, count(*) AS n FROM (SELECT ticker, CAST(dt + INTERVAL 8000 DAY AS DATE) AS dt FROM panel) GROUP BY ALL")
def era_case(spark, d):
    return panel(spark, d).select("ticker", X.era(F.date_add("dt", 8000)).alias("era")).groupBy("ticker", "era").agg(F.count("*").alias("n"))


@query("SELECT ticker, idx, horizon, substr(sha256(ticker || ':' || CAST(dt AS VARCHAR) || ':H' || horizon || ':v1'), 1, 16) AS forecast_id FROM ahead")
def forecast_id_hash(spark, d):
    f = X.forward_returns(panel(spark, d))
    return f.select("ticker", "idx", "horizon", scalar.forecast_id(F.col("ticker"), F.col("dt"), F.col("horizon"), F.lit("v1")).alias("forecast_id"))
