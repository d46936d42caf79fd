"""Forecast score queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremorlab.operators import metrics as M
from tremorlab.operators import quality as Q
from tremorlab.plans.base import R, pairs, panel, rets, scored
from tremorlab.plans.registry import cte, query, r6

K = ["config", "ticker", "horizon"]
KS = "config, ticker, horizon"
LL = "-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))"
BSS = "CASE WHEN avg(y) * (1 - avg(y)) >= 1e-15 THEN 1 - avg(pow(p - y, 2)) / (avg(y) * (1 - avg(y))) END"


def _basic(name, column, sql):
    def run(spark, d):
        return M.basic(pairs(spark, d), K).select(*K, R(column, column))

    run.__name__ = name
    query(f"SELECT {KS}, {r6(sql)} AS {column} FROM known GROUP BY ALL")(run)


for _n, _c, _s in (
    ("brier", "brier", "avg(pow(p - y, 2))"),
    ("log_loss", "log_loss", f"avg({LL})"),
    ("separation", "separation", "avg(p) FILTER (y = 1) - avg(p) FILTER (y = 0)"),
    ("bss", "bss", BSS),
):
    _basic(_n, _c, _s)

cte("ranked", "SELECT *, rank() OVER (PARTITION BY config, ticker, horizon ORDER BY p) + (count(*) OVER (PARTITION BY config, ticker, horizon, p) - 1) / 2 AS rk FROM known")
cte("aucs", f"SELECT {KS}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auc FROM ranked GROUP BY ALL")
cte("width_bins", f"SELECT {KS}, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y, abs(avg(p) - avg(y)) AS gap FROM known GROUP BY ALL")
cte("eces", f"SELECT {KS}, sum(n * gap) / sum(n) AS ece FROM width_bins GROUP BY ALL")
cte("edges", f"SELECT {KS}, list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM known GROUP BY ALL")
cte("adaptive", f"SELECT {KS}, bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y, abs(avg(p) - avg(y)) AS gap FROM (SELECT *, CAST(greatest(1, least(len(list_filter(e, lambda x: x <= p)), len(e) - 1)) AS INTEGER) AS bin FROM known JOIN edges USING ({KS})) GROUP BY ALL")


@query(f"SELECT {KS}, {r6('auc')} AS auc FROM aucs")
def auc_midrank(spark, d):
    return M.auc(pairs(spark, d), K).select(*K, R("auc", "auc"))


@query(f"SELECT {KS}, {r6('ece')} AS ece FROM eces")
def ece_width(spark, d):
    return M.ece(pairs(spark, d), K).select(*K, R("ece", "ece"))


@query(f"SELECT {KS}, bin, n, {r6('mean_p')} AS mean_p, {r6('mean_y')} AS mean_y, {r6('gap')} AS gap FROM width_bins")
def ece_bins(spark, d):
    return M.ece_bins(pairs(spark, d), K).select(*K, "bin", "n", R("mean_p", "mean_p"), R("mean_y", "mean_y"), R("gap", "gap"))


@query(f"SELECT {KS}, {r6('sum(n * gap) / sum(n)')} AS ece FROM adaptive GROUP BY ALL")
def ece_adaptive(spark, d):
    return M.ece_adaptive(pairs(spark, d), K).select(*K, R("ece_adaptive", "ece"))


@query(f"SELECT {KS}, bin, n, {r6('mean_p')} AS mean_p, {r6('mean_y')} AS mean_y FROM adaptive")
def calibration_bins_adaptive(spark, d):
    return M.adaptive_bins(pairs(spark, d), K).select(*K, "bin", "n", R("mean_p", "mean_p"), R("mean_y", "mean_y"))


cte("resid", f"SELECT {KS}, idx, (p - y) - avg(p - y) OVER (PARTITION BY {KS}) AS d FROM known")
_lags = ", ".join(f"avg(d * l{k}) AS c{k}" for k in range(1, 10))
_sum = " + ".join(f"2 * greatest(0, 1 - {k}::DOUBLE / horizon) * coalesce(c{k}, 0) / var" for k in range(1, 10))
cte("neff", f"SELECT {KS}, CASE WHEN n <= horizon OR var < 1e-15 OR 1 + {_sum} <= 0 THEN n ELSE greatest(1.0, least(n, n / (1 + {_sum}))) END AS n_eff FROM (SELECT {KS}, CAST(count(*) AS DOUBLE) AS n, avg(d * d) AS var, {_lags} FROM (SELECT *, {', '.join(f'lag(d, {k}) OVER (PARTITION BY {KS} ORDER BY idx) AS l{k}' for k in range(1, 10))} FROM resid) GROUP BY ALL)")


@query(f"SELECT {KS}, {r6('n_eff')} AS n_eff FROM neff")
def n_eff(spark, d):
    each = [M.n_eff(pairs(spark, d).where(f"horizon = {h}"), K, h) for h in (5, 10)]
    return each[0].unionByName(each[1]).select(*K, R("n_eff", "n_eff"))


# quantile forecasts: trailing empirical quantiles of the last 252 known outcomes
QL = "[0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]"
cte("quantiles", f"SELECT ticker, horizon, idx, ret_h AS x, quantile_cont(ret_h, {QL}) OVER (PARTITION BY ticker, horizon ORDER BY dt ROWS BETWEEN 262 PRECEDING AND 11 PRECEDING) AS q FROM labelled")
cte("qf", "SELECT * FROM quantiles WHERE idx >= 300 AND x IS NOT NULL")
MIDS = "[0.03, 0.075, 0.175, 0.375, 0.625, 0.825, 0.925, 0.97]"
cte("crps_rows", f"SELECT *, list_sum([CASE WHEN q[i + 1] > q[i] THEN pow(({QL}[i] + {QL}[i + 1]) / 2 - CASE WHEN x <= (q[i] + q[i + 1]) / 2 THEN 1 ELSE 0 END, 2) * (q[i + 1] - q[i]) ELSE 0 END FOR i IN range(1, 9)]) AS crps FROM qf")
cte("pit_rows", f"""SELECT *, CASE WHEN k = 0 THEN 0.01 WHEN k >= 9 THEN 0.99 WHEN q[k + 1] > q[k] THEN {QL}[k] + ({QL}[k + 1] - {QL}[k]) * (x - q[k]) / (q[k + 1] - q[k]) ELSE ({QL}[k] + {QL}[k + 1]) / 2 END AS pit
 FROM (SELECT *, len(list_filter(q, lambda v: v <= x)) AS k FROM qf)""")


def _quantile_forecasts(spark, d):
    from tremorlab.plans.base import labelled

    w = Window.partitionBy("ticker", "horizon").orderBy("dt").rowsBetween(-262, -11)
    q = F.percentile("ret_h", F.array(*map(F.lit, M.LEVELS))).over(w)
    return labelled(spark, d).select("ticker", "horizon", "idx", F.col("ret_h").alias("x"), q.alias("q")).where("idx >= 300 and x is not null")


@query(f"SELECT ticker, horizon, {r6('avg(crps)')} AS crps FROM crps_rows GROUP BY ALL")
def crps(spark, d):
    return _quantile_forecasts(spark, d).groupBy("ticker", "horizon").agg(R(F.avg(M.crps(F.col("q"), F.col("x"))), "crps"))


@query(f"SELECT ticker, horizon, idx, {r6('pit')} AS pit FROM pit_rows")
def pit(spark, d):
    return _quantile_forecasts(spark, d).select("ticker", "horizon", "idx", R(M.pit(F.col("q"), F.col("x")), "pit"))


@query(f"SELECT ticker, horizon, {r6('max(greatest(i / n - pit, pit - (i - 1) / n))')} AS ks FROM (SELECT *, row_number() OVER (PARTITION BY ticker, horizon ORDER BY pit) AS i, count(*) OVER (PARTITION BY ticker, horizon) AS n FROM pit_rows) GROUP BY ALL")
def pit_ks(spark, d):
    f = _quantile_forecasts(spark, d).withColumn("pit", M.pit(F.col("q"), F.col("x")))
    return M.ks_uniform(f, ["ticker", "horizon"]).select("ticker", "horizon", R("ks", "ks"))


@query(f"SELECT ticker, horizon, {r6('abs(avg(CASE WHEN x >= q[2] AND x <= q[8] THEN 1.0::DOUBLE ELSE 0 END) - 0.9)')} AS coverage_error FROM qf GROUP BY ALL")
def interval_coverage(spark, d):
    f = _quantile_forecasts(spark, d)
    return M.coverage_error(f, ["ticker", "horizon"], F.col("q")[1], F.col("q")[7], F.col("x"), 0.9).select("ticker", "horizon", R("coverage_error", "coverage_error"))


@query(f"""SELECT ticker, idx, {r6('least(1.0, min(a) OVER (PARTITION BY ticker ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS p_adjusted FROM
 (SELECT *, pv * n / r AS a FROM (SELECT ticker, idx, pv, row_number() OVER (PARTITION BY ticker ORDER BY pv) AS r, count(*) OVER (PARTITION BY ticker) AS n FROM (SELECT ticker, idx, p AS pv FROM scored WHERE horizon = 5)))""")
def fdr_bh(spark, d):
    f = scored(spark, d).where("horizon = 5").select("ticker", "idx", F.col("p").alias("p_value"))
    return M.fdr(f, ["ticker"]).select("ticker", "idx", R("p_adjusted", "p_adjusted"))


@query(f"""SELECT {KS}, {r6('stddev_pop(p)')} AS sd, {r6('quantile_cont(p, 0.75) - quantile_cont(p, 0.25)')} AS iqr, {r6('max(p) - min(p)')} AS span, {r6('avg(CASE WHEN abs(p - rate) > 0.05 THEN 1.0::DOUBLE ELSE 0 END)')} AS far
FROM (SELECT *, avg(y) OVER (PARTITION BY {KS}) AS rate FROM known) GROUP BY ALL HAVING count(*) >= 10""")
def sharpness(spark, d):
    return M.sharpness(pairs(spark, d), K).select(*K, *[R(c, c) for c in ("sd", "iqr", "span", "far")])


@query(f"""SELECT {KS}, third, {r6('sum(n * gap) / sum(n)')} AS ece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {KS}, third, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM
 (SELECT k.*, CASE WHEN vol_20 < c[1] THEN 'low' WHEN vol_20 > c[2] THEN 'high' ELSE 'mid' END AS third FROM known k JOIN (SELECT {KS}, quantile_cont(vol_20, [0.33, 0.67]) AS c FROM known WHERE vol_20 IS NOT NULL GROUP BY ALL) USING ({KS}) WHERE vol_20 IS NOT NULL) GROUP BY ALL)
GROUP BY {KS}, third HAVING sum(n) >= 30""")
def conditional_ece(spark, d):
    return M.conditional_ece(pairs(spark, d), K, "vol_20").select(*K, "third", R("ece", "ece"), "n")


@query(f"SELECT ticker, {r6('-any_value(c)')} AS var, {r6('-avg(ret) FILTER (ret <= c)')} AS cvar FROM (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY ticker) AS c FROM rets WHERE ret IS NOT NULL) GROUP BY ticker")
def var_cvar(spark, d):
    return M.tail_risk(rets(spark, d), ["ticker"]).select("ticker", R("var", "var"), R("cvar", "cvar"))


@query(f"""SELECT ticker, horizon, {r6('avg(ret_h)')} AS mean, {r6('stddev_pop(ret_h)')} AS sd, {r6('-any_value(c)')} AS var, {r6('-avg(ret_h) FILTER (ret_h <= c)')} AS cvar, {r6('any_value(n) / ((any_value(n) - 1) * (any_value(n) - 2)) * sum(pow((ret_h - m) / s, 3))')} AS skew
FROM (SELECT *, quantile_cont(ret_h, 0.05) OVER w AS c, avg(ret_h) OVER w AS m, stddev_samp(ret_h) OVER w AS s, CAST(count(*) OVER w AS DOUBLE) AS n FROM labelled WHERE ret_h IS NOT NULL WINDOW w AS (PARTITION BY ticker, horizon)) GROUP BY ticker, horizon""")
def risk_report(spark, d):
    from tremorlab.plans.base import labelled

    f = labelled(spark, d).where("ret_h is not null")
    k = ["ticker", "horizon"]
    a = f.groupBy(*k).agg(F.avg("ret_h").alias("mean"), F.stddev_pop("ret_h").alias("sd"))
    out = a.join(M.tail_risk(f, k, "ret_h"), k).join(Q.skew_kurt(f, "ret_h", k), k)
    return out.select(*k, *[R(c, c) for c in ("mean", "sd", "var", "cvar", "skew")])


@query(f"""SELECT config, ticker, horizon, overlap, count(*) AS n, {r6('avg(pow(p - y, 2))')} AS brier, {r6(BSS)} AS bss FROM (SELECT *, 'all' AS overlap FROM known UNION ALL
 SELECT * EXCLUDE (i), 'every_h' FROM (SELECT *, row_number() OVER (PARTITION BY {KS} ORDER BY idx) - 1 AS i FROM known) WHERE i % horizon = 0) GROUP BY ALL""")
def metrics_overlap_vs_non(spark, d):
    f = pairs(spark, d)
    both = M.valid(f).withColumn("overlap", F.lit("all")).unionByName(M.every_hth(f, K).withColumn("overlap", F.lit("every_h")))
    return M.basic(both, [*K, "overlap"]).select(*K, "overlap", "n", R("brier", "brier"), R("bss", "bss"))


WN = "(1.96 * 1.96 / n)"


@query(f"""SELECT {KS}, bin, n, {r6(f'((mean_y + {WN} / 2) - 1.96 * sqrt(mean_y * (1 - mean_y) / n + {WN} / 4 / n)) / (1 + {WN})')} AS wilson_lo, {r6(f'((mean_y + {WN} / 2) + 1.96 * sqrt(mean_y * (1 - mean_y) / n + {WN} / 4 / n)) / (1 + {WN})')} AS wilson_hi FROM width_bins""")
def reliability_wilson(spark, d):
    return M.reliability(pairs(spark, d), K).select(*K, "bin", "n", R("wilson_lo", "wilson_lo"), R("wilson_hi", "wilson_hi"))


@query(f"SELECT {KS}, round(2 * 2 + 2 * sum({LL}), 4) + 0.0 AS aic, round(2 * ln(count(*)) + 2 * sum({LL}), 4) + 0.0 AS bic FROM known GROUP BY ALL")
def aic_bic(spark, d):
    return M.aic_bic(pairs(spark, d), K, 2).select(*K, F.round("aic", 4).alias("aic"), F.round("bic", 4).alias("bic"))


@query(f"SELECT {KS}, idx, {r6(f'CASE WHEN count(*) OVER w >= 30 THEN avg(pow(p - y, 2)) OVER w END')} AS rolling_brier FROM known WINDOW w AS (PARTITION BY {KS} ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def rolling_brier(spark, d):
    return M.rolling_brier(pairs(spark, d), K).select(*K, "idx", R("rolling_brier", "rolling_brier"))


@query(f"SELECT {KS}, CAST(hop AS INTEGER) AS hop, {r6('avg(pow(p - y, 2))')} AS brier, {r6('avg(y)')} AS rate FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((i - 49) / 10)) AS BIGINT), CAST(floor(i / 10) AS BIGINT) + 1)) AS hop FROM (SELECT *, row_number() OVER (PARTITION BY {KS} ORDER BY idx) - 1 AS i FROM known)) GROUP BY ALL HAVING count(*) = 50")
def hop_window_metrics(spark, d):
    return M.hop_windows(pairs(spark, d), K).select(*K, "hop", R("brier", "brier"), R("rate", "rate"))


@query(f"SELECT ticker, {r6('min(price / m - 1)')} AS max_drawdown, arg_min(idx, price / m - 1) AS trough_idx FROM (SELECT *, max(price) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM panel) GROUP BY ticker")
def max_drawdown(spark, d):
    return M.drawdown(panel(spark, d), ["ticker"]).select("ticker", R("max_drawdown", "max_drawdown"), "trough_idx")


@query(f"SELECT {KS}, {r6('avg(abs(p - b))')} AS turnover FROM (SELECT *, lag(p) OVER (PARTITION BY {KS} ORDER BY idx) AS b FROM known) GROUP BY ALL")
def signal_turnover(spark, d):
    w = Window.partitionBy(*K).orderBy("idx")
    return M.valid(pairs(spark, d)).withColumn("b", F.lag("p").over(w)).groupBy(*K).agg(R(F.avg(F.abs(F.col("p") - F.col("b"))), "turnover"))


@query(f"SELECT {KS}, {r6('avg(CASE WHEN (p >= 0.25) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END)')} AS hit_rate, count(*) FILTER (p >= 0.25) AS n_high, {r6('avg(y) FILTER (p >= 0.25)')} AS precision, {r6('count(*) FILTER (p >= 0.25 AND y = 1) / nullif(sum(y), 0)')} AS recall FROM known GROUP BY ALL")
def backtest_hit_rate(spark, d):
    f = M.valid(pairs(spark, d))
    high, hit = F.col("p") >= 0.25, F.col("y") == 1
    return f.groupBy(*K).agg(
        R(F.avg(F.when(high == hit, 1.0).otherwise(0.0)), "hit_rate"),
        F.count_if(high).alias("n_high"),
        R(F.avg(F.when(high, F.col("y"))), "precision"),
        R(F.count_if(high & hit) / F.expr("nullif(sum(y), 0)"), "recall"),
    )


@query("SELECT a.ticker AS a, b.ticker AS b, horizon, " + r6("corr(a.p, b.p)") + " AS corr FROM scored a JOIN scored b USING (dt, horizon) WHERE a.ticker < b.ticker GROUP BY ALL")
def cross_corr(spark, d):
    s = scored(spark, d).select("ticker", "dt", "horizon", "p")
    j = s.alias("a").join(s.alias("b"), ["dt", "horizon"]).where("a.ticker < b.ticker")
    return j.groupBy(F.col("a.ticker").alias("a"), F.col("b.ticker").alias("b"), "horizon").agg(R(F.corr("a.p", "b.p"), "corr"))


@query(f"SELECT ticker, horizon, count(*) AS n, {r6('avg(y)')} AS rate, {r6('avg(pow(p - y, 2))')} AS brier, {r6(BSS)} AS bss FROM known WHERE config = 'base' GROUP BY ALL")
def base_rate_scorecard(spark, d):
    f = pairs(spark, d).where("config = 'base'")
    return M.basic(f, ["ticker", "horizon"]).select("ticker", "horizon", "n", R("rate", "rate"), R("brier", "brier"), R("bss", "bss"))
