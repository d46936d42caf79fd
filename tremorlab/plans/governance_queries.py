"""Cross-validation, gates, significance, economics and ledger queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremorlab.operators import calibrate as C
from tremorlab.operators import econ as E
from tremorlab.operators import govern as G
from tremorlab.operators import ledger as LG
from tremorlab.operators import metrics as M
from tremorlab.plans.base import R, labelled, pairs, rets, scored
from tremorlab.plans.metric_queries import BSS, LL
from tremorlab.plans.registry import cte, query, r6

cte("fold_at", "SELECT *, floor((max(idx) OVER (PARTITION BY ticker) + 1) * 0.4) AS st, floor((max(idx) OVER (PARTITION BY ticker) + 1 - floor((max(idx) OVER (PARTITION BY ticker) + 1) * 0.4)) / 5) AS sz FROM pairs")
cte("oof", "SELECT * REPLACE (CASE WHEN idx + horizon < st + (fold + 1) * sz THEN y END AS y) FROM (SELECT *, CAST(floor((idx - st) / sz) AS INTEGER) AS fold FROM fold_at WHERE idx >= st) WHERE fold < 5")


def _scores(name: str, src: str, keys: str) -> None:
    """Sub-queries ``name`` with every score of ``src`` by ``keys``."""
    cte(f"{name}_ok", f"SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY p) + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2 AS rk FROM {src} WHERE p IS NOT NULL AND y IS NOT NULL")
    cte(f"{name}_b", f"SELECT {keys}, least(floor(p * 10), 9) AS b, count(*) AS c, abs(avg(p) - avg(y)) AS g FROM {name}_ok GROUP BY ALL")
    cte(f"{name}_e", f"SELECT {keys}, sum(c * g) / sum(c) AS ece FROM {name}_b GROUP BY ALL")
    cte(f"{name}_s", f"SELECT {keys}, count(*) AS n, sum(y) AS pos, avg(y) AS rate, {BSS} AS bss, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auc FROM {name}_ok GROUP BY ALL")
    cte(name, f"SELECT * FROM {name}_s JOIN {name}_e USING ({keys})")


_scores("by_fold", "oof", "config, fold, horizon")
cte("sliced", "SELECT * FROM (SELECT o.*, unnest(CASE WHEN vol_20 IS NULL THEN ['all'] ELSE ['all', CASE WHEN vol_20 < c[1] THEN 'low' WHEN vol_20 > c[2] THEN 'high' ELSE 'mid' END] END) AS slice FROM oof o JOIN (SELECT config, horizon, quantile_cont(vol_20, [0.33, 0.66]) AS c FROM oof WHERE vol_20 IS NOT NULL GROUP BY ALL) USING (config, horizon))")
_scores("by_slice", "sliced", "config, horizon, slice")
cte("gates", """SELECT config, horizon, slice, n, enough, m.metric AS metric, m.value AS value, m.threshold AS threshold, (m.value - m.threshold) * m.sign AS margin, CASE WHEN enough AND m.value IS NOT NULL THEN (m.value - m.threshold) * m.sign >= 0 END AS passed
FROM (SELECT *, n >= 100 AND pos >= 30 AND n - pos >= 30 AS enough, unnest([{'metric': 'bss', 'value': bss, 'threshold': 0.0, 'sign': 1}, {'metric': 'auc', 'value': auc, 'threshold': 0.55, 'sign': 1}, {'metric': 'ece', 'value': ece, 'threshold': 0.02, 'sign': -1}]) AS m FROM by_slice)""")
KG = ["config", "horizon", "slice"]


def _oof(spark, d):
    return G.folds(pairs(spark, d))


def _gates(spark, d):
    return G.gate_report(G.by_regime(_oof(spark, d), ["config", "horizon"]), KG)


@query("SELECT config, ticker, horizon, fold, CAST(min(idx) AS INTEGER) AS first_idx, CAST(max(idx) AS INTEGER) AS last_idx, count(*) AS n, count(y) AS n_labelled FROM oof GROUP BY ALL")
def cv_folds(spark, d):
    return _oof(spark, d).groupBy("config", "ticker", "horizon", "fold").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n"), F.count("y").alias("n_labelled"))


@query(f"""SELECT config, horizon, {r6('bss_mean')} AS bss_mean, {r6('bss_sd')} AS bss_sd, {r6('auc_mean')} AS auc_mean, {r6('ece_mean')} AS ece_mean, folds, n, CASE WHEN bss_mean IS NOT NULL THEN CAST(rank() OVER (PARTITION BY horizon ORDER BY bss_mean DESC NULLS LAST) AS INTEGER) END AS rank FROM
 (SELECT config, horizon, avg(bss) AS bss_mean, stddev_samp(bss) AS bss_sd, avg(auc) AS auc_mean, avg(ece) AS ece_mean, count(*) AS folds, CAST(sum(n) AS BIGINT) AS n FROM by_fold GROUP BY ALL)""")
def cv_summary_rank(spark, d):
    f = G.fold_summary(_oof(spark, d))
    return f.select("config", "horizon", *[R(c, c) for c in ("bss_mean", "bss_sd", "auc_mean", "ece_mean")], "folds", "n", "rank")


@query(f"SELECT config, horizon, slice, metric, n, enough, {r6('value')} AS value, {r6('margin')} AS margin, passed FROM gates")
def gates_pooled_regime(spark, d):
    return _gates(spark, d).select(*KG, "metric", "n", "enough", R("value", "value"), R("margin", "margin"), "passed")


@query("SELECT config, horizon, CASE WHEN NOT bool_and(enough) THEN 'UNDECIDED' WHEN bool_and(coalesce(passed, false)) THEN 'PASS' ELSE 'FAIL' END AS status FROM gates GROUP BY ALL")
def promotion_status(spark, d):
    return G.promotion(_gates(spark, d), ["config", "horizon"])


@query("SELECT config, horizon, slice, metric, bool_and(coalesce(passed, false)) OVER (PARTITION BY config, horizon) AS all_passed FROM gates")
def gates_annotated(spark, d):
    return G.annotate(_gates(spark, d), ["config", "horizon"]).select(*KG, "metric", "all_passed")


@query("SELECT config, horizon, slice, coalesce(CASE WHEN enough THEN value <= 0.04 END, false) AS shadow_passed FROM gates WHERE metric = 'ece'")
def shadow_gate(spark, d):
    f = G.gate_report(G.by_regime(_oof(spark, d), ["config", "horizon"]), KG, gates={"ece": (0.04, "<=")})
    return f.select(*KG, F.coalesce("passed", F.lit(False)).alias("shadow_passed"))


cte("era_slices", "SELECT *, 'era' AS slicing, CASE WHEN dt <= DATE '1998-06-30' THEN 'first' ELSE 'second' END AS slice FROM oof UNION ALL SELECT *, 'regime', regime FROM oof")
_scores("by_era", "era_slices", "config, horizon, slicing, slice")


@query(f"SELECT config, horizon, slicing, slice, n, {r6('bss')} AS bss, {r6('auc')} AS auc, {r6('ece')} AS ece FROM by_era")
def conditional_gates(spark, d):
    era = F.when(F.col("dt") <= F.lit("1998-06-30").cast("date"), "first").otherwise("second")
    k = ["config", "horizon", "slicing", "slice"]
    return G.all_scores(G.slices(_oof(spark, d), era=era, regime=F.col("regime")), k).select(*k, "n", R("bss", "bss"), R("auc", "auc"), R("ece", "ece"))


@query(f"SELECT config, horizon, {r6('avg(pow(p - y, 2))')} AS model, {r6('avg(pow(c - y, 2))')} AS climate, {r6('1 - avg(pow(p - y, 2)) / avg(pow(c - y, 2))')} AS skill FROM (SELECT *, avg(y) OVER (PARTITION BY config, horizon) AS c FROM oof WHERE y IS NOT NULL AND p IS NOT NULL) GROUP BY ALL")
def benchmark_vs_climatology(spark, d):
    return G.benchmark(_oof(spark, d), ["config", "horizon"]).select("config", "horizon", R("model", "model"), R("climate", "climate"), R("skill", "skill"))


@query(f"SELECT a.config AS a, b.config AS b, horizon, count(*) AS n, {r6('avg(pow(a.p - a.y, 2) - pow(b.p - b.y, 2))')} AS diff FROM (SELECT * FROM oof WHERE y IS NOT NULL AND p IS NOT NULL) a JOIN (SELECT * FROM oof WHERE y IS NOT NULL AND p IS NOT NULL) b USING (ticker, idx, horizon, fold) WHERE a.config < b.config GROUP BY ALL")
def pairwise_loss(spark, d):
    return G.pairwise(_oof(spark, d), ["ticker", "idx", "horizon", "fold"], ["horizon"]).select("a", "b", "horizon", "n", R("diff", "diff"))


cte("overfit", "SELECT config, horizon, stddev_samp(ece) / avg(ece) AS fold_cv, avg(ece) FILTER (fold <= 1) AS early, avg(ece) FILTER (fold >= 3) AS late FROM by_fold GROUP BY ALL")
LIGHT = "CASE WHEN {v} <= {g} THEN 'GREEN' WHEN {v} <= {y} THEN 'YELLOW' ELSE 'RED' END"


@query(f"SELECT config, horizon, {r6('fold_cv')} AS fold_cv, {LIGHT.format(v='fold_cv', g=0.3, y=0.6)} AS cv_status FROM overfit")
def overfit_fold_cv(spark, d):
    return G.overfit(_oof(spark, d)).select("config", "horizon", R("fold_cv", "fold_cv"), "cv_status")


@query(f"SELECT config, horizon, {r6('early')} AS early, {r6('late')} AS late, {LIGHT.format(v='(late / early - 1)', g=0.25, y=0.75)} AS drift_status FROM overfit")
def overfit_early_late(spark, d):
    return G.overfit(_oof(spark, d)).select("config", "horizon", R("early", "early"), R("late", "late"), "drift_status")


@query(f"SELECT horizon, CASE max(r) WHEN 2 THEN 'RED' WHEN 1 THEN 'YELLOW' ELSE 'GREEN' END AS worst, max(r) <= 1 AS acceptable FROM (SELECT horizon, greatest(CASE WHEN fold_cv > 0.6 THEN 2 WHEN fold_cv > 0.3 THEN 1 ELSE 0 END, CASE WHEN late / early - 1 > 0.75 THEN 2 WHEN late / early - 1 > 0.25 THEN 1 ELSE 0 END) AS r FROM overfit) GROUP BY horizon")
def overfit_gate(spark, d):
    return G.worst(G.overfit(_oof(spark, d)), ["horizon"], ["cv_status", "drift_status"])


@query(f"SELECT ticker, horizon, CAST(s AS DOUBLE) AS shift, {r6('avg(CASE WHEN abs(ret_h) >= tau * s THEN 1.0::DOUBLE ELSE 0 END)')} AS rate FROM (SELECT *, unnest([0.9::DOUBLE, 1.0, 1.1]) AS s FROM labelled WHERE ret_h IS NOT NULL) GROUP BY ALL")
def threshold_sensitivity(spark, d):
    return G.threshold_sensitivity(labelled(spark, d)).select("ticker", "horizon", "shift", R("rate", "rate"))


@query(f"SELECT config, horizon, {r6('any_value(bss) FILTER (ticker = ' + repr('A') + ')')} AS \"A\", {r6('any_value(bss) FILTER (ticker = ' + repr('N') + ')')} AS \"N\", {r6('any_value(bss) FILTER (ticker = ' + repr('R') + ')')} AS \"R\" FROM (SELECT config, ticker, horizon, {BSS} AS bss FROM known GROUP BY ALL) GROUP BY config, horizon")
def pivot_config_ticker(spark, d):
    s = M.basic(pairs(spark, d), ["config", "ticker", "horizon"])
    return s.groupBy("config", "horizon").pivot("ticker", ["A", "N", "R"]).agg(F.first("bss")).select("config", "horizon", R("A", "A"), R("N", "N"), R("R", "R"))


@query("SELECT config, regime, horizon, count(*) AS n, count(*) FILTER (p >= 0.25) AS n_high FROM pairs GROUP BY ALL")
def stress_routing_counts(spark, d):
    return pairs(spark, d).groupBy("config", "regime", "horizon").agg(F.count("*").alias("n"), F.count_if(F.col("p") >= 0.25).alias("n_high"))


cte("daily", "SELECT r.ticker, r.idx, r.dt, r.ret / 20 AS ret, s.p FROM rets r LEFT JOIN scored s ON s.ticker = r.ticker AND s.idx = r.idx AND s.horizon = 5")
cte("carry", "SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pc, lag(p) OVER (PARTITION BY ticker ORDER BY idx) AS pl FROM daily")
cte("managed", "SELECT *, w * ret - abs(w - CASE WHEN coalesce(pl, pc, 0) >= 0.2 THEN 0.5 ELSE 1 END) * 5 / 1e4 AS net FROM (SELECT *, CASE WHEN coalesce(pc, 0) >= 0.2 THEN 0.5 ELSE 1 END AS w FROM carry)")


def _daily(spark, d):
    s = scored(spark, d).where("horizon = 5").select("ticker", "idx", "p")
    return rets(spark, d).select("ticker", "idx", "dt", (F.col("ret") / 20).alias("ret")).join(s, ["ticker", "idx"], "left")


@query(f"SELECT ticker, idx, {r6('exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS equity FROM daily")
def equity_curve(spark, d):
    return E.equity_curve(_daily(spark, d)).select("ticker", "idx", R("equity", "equity"))


@query(f"SELECT ticker, count(*) AS n, {r6('avg(net) * 252')} AS annual, {r6('stddev_pop(net) * sqrt(252)')} AS vol, {r6('avg(net) / stddev_pop(net) * sqrt(252)')} AS sharpe, {r6('-avg(net) FILTER (net <= c)')} AS cvar FROM (SELECT *, quantile_cont(net, 0.05) OVER (PARTITION BY ticker) AS c FROM managed WHERE net IS NOT NULL) GROUP BY ticker")
def risk_managed_portfolio(spark, d):
    return E.performance(E.managed(_daily(spark, d)), ["ticker"], "net").select("ticker", "n", *[R(c, c) for c in ("annual", "vol", "sharpe", "cvar")])


HEDGE = "greatest(ret_h, -tau) - 0.002"


@query(f"SELECT ticker, horizon, {r6('avg(ret_h)')} AS unhedged, {r6(f'avg({HEDGE})')} AS always, {r6(f'avg(CASE WHEN p >= 0.25 THEN {HEDGE} ELSE ret_h END)')} AS selective FROM scored WHERE ret_h IS NOT NULL GROUP BY ALL")
def selective_hedging(spark, d):
    f = E.hedging(scored(spark, d).where("ret_h is not null"), 0.25)
    return f.groupBy("ticker", "horizon").agg(*[R(F.avg(c), c) for c in ("unhedged", "always", "selective")])


@query(f"SELECT ticker, horizon, CAST(t AS DOUBLE) AS threshold, CAST(c AS DOUBLE) AS premium, {r6('avg(CASE WHEN p >= t THEN greatest(ret_h, -tau) - c ELSE ret_h END)')} AS selective FROM scored, (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.4]) AS t), (SELECT unnest([0.0::DOUBLE, 0.001, 0.002, 0.005]) AS c) WHERE ret_h IS NOT NULL GROUP BY ALL")
def economic_sweep(spark, d):
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(c).alias("premium")) for t in (0.1, 0.2, 0.3, 0.4) for c in (0.0, 0.001, 0.002, 0.005)])).alias("g")
    f = scored(spark, d).where("ret_h is not null").select("ticker", "horizon", "p", "ret_h", "tau", grid).select("*", "g.*")
    sel = F.when(F.col("p") >= F.col("threshold"), F.greatest(F.col("ret_h"), -F.col("tau")) - F.col("premium")).otherwise(F.col("ret_h"))
    return f.groupBy("ticker", "horizon", "threshold", "premium").agg(R(F.avg(sel), "selective"))


# ledger: every signup is a forecast, the user's first later purchase its resolution
cte("forecasts", "SELECT *, substr(sha256(CAST(event_id AS VARCHAR)), 1, 16) AS forecast_id FROM events WHERE event_type = 'signup'")
cte("resolutions", "SELECT f.forecast_id, arg_min(e.event_id, (e.ts, e.event_id)) AS resolved_by, arg_min(e.value, (e.ts, e.event_id)) AS outcome FROM forecasts f JOIN events e ON e.user_id = f.user_id AND e.event_type = 'purchase' AND e.ts > f.ts GROUP BY f.forecast_id")
cte("live", "SELECT f.event_id, f.user_id % 5 AS grp, f.user_id % 2 AS version, f.value / 200 AS p, CASE WHEN r.outcome IS NULL THEN NULL WHEN r.outcome > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM forecasts f LEFT JOIN resolutions r USING (forecast_id)")


@query("SELECT event_id, forecast_id, resolved_by FROM forecasts LEFT JOIN resolutions USING (forecast_id)")
def ledger_left_join(spark, d):
    f, r = LG.from_events(spark.read.parquet(f"{d}/events.parquet"))
    return LG.joined(f, r).select("event_id", "forecast_id", "resolved_by")


@query("SELECT event_id, forecast_id FROM forecasts ANTI JOIN resolutions USING (forecast_id)")
def pending_antijoin(spark, d):
    f, r = LG.from_events(spark.read.parquet(f"{d}/events.parquet"))
    return LG.pending(f, r).select("event_id", "forecast_id")


def _live(spark, d):
    f, r = LG.from_events(spark.read.parquet(f"{d}/events.parquet"))
    y = F.when(F.col("outcome").isNull(), None).when(F.col("outcome") > 50, 1.0).otherwise(0.0)
    return LG.joined(f, r).select("event_id", (F.col("user_id") % 5).alias("grp"), (F.col("user_id") % 2).alias("version"), (F.col("value") / 200).alias("p"), y.alias("y"))


@query(f"SELECT grp, version, count(*) AS n, count(y) AS n_resolved, {r6('avg(pow(p - y, 2))')} AS brier, count(y) < 30 AS small FROM live GROUP BY GROUPING SETS ((grp), (version), ())")
def live_metrics_grouping_sets(spark, d):
    return LG.live_metrics(_live(spark, d), ["grp", "version"]).select("grp", "version", "n", "n_resolved", R("brier", "brier"), "small")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def latest_100(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "user_id")


@query("SELECT ticker, CAST(arg_max(idx, dt) AS INTEGER) AS idx, format('{} at {:.2f} over {} days', ticker, arg_max(price, dt), 5) AS phrase FROM panel GROUP BY ticker")
def latest_summary(spark, d):
    from tremorlab.plans.base import panel

    f = panel(spark, d).groupBy("ticker").agg(F.max_by(F.struct("idx", "price"), "dt").alias("m"))
    return f.select("ticker", F.col("m.idx").alias("idx"), F.format_string("%s at %.2f over %d days", F.col("ticker"), F.col("m.price"), F.lit(5)).alias("phrase"))


# calibration: ordered folds as recursive queries, histogram correction as a batch
cte("steps", "SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY idx) AS INTEGER) AS i, p, y FROM scored WHERE horizon = 5 AND y IS NOT NULL AND p IS NOT NULL")
LG7 = "ln(greatest(1e-7, least(1 - 1e-7, p)) / (1 - greatest(1e-7, least(1 - 1e-7, p))))"
SIG = "1 / (1 + exp(-greatest(-50.0, least(50.0, {x}))))"
OUT = f"(CASE WHEN n < 50 THEN s.p ELSE {SIG.format(x='a * x + b')} END - s.y)"
cte(
    "platt_walk",
    f"""SELECT DISTINCT ticker, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0 AS n FROM steps UNION ALL
 SELECT w.ticker, a - 0.05 / sqrt(1 + n) * {OUT} * x, b - 0.05 / sqrt(1 + n) * {OUT}, n + 1 FROM platt_walk w JOIN (SELECT *, {LG7} AS x FROM steps) s ON s.ticker = w.ticker AND s.i = w.n + 1""",
    recursive=True,
)


@query(f"""SELECT ticker, {r6('a')} AS a, {r6('b')} AS b, n FROM (SELECT ticker, a, b, n, max(n) OVER (PARTITION BY ticker) AS m FROM platt_walk) WHERE n = m""")
def platt_fold(spark, d):
    s = scored(spark, d).where("horizon = 5 and y is not null and p is not null")
    return C.platt_fold(s, ["ticker"]).select("ticker", R("a", "a"), R("b", "b"), "n")


@query(f"""SELECT {'config, ticker, horizon'}, bin, n, {r6('CASE WHEN n >= 15 THEN n / (n + 15) * (mean_y - mean_p) ELSE 0.0 END')} AS correction FROM width_bins""")
def histogram_correction_batch(spark, d):
    f = pairs(spark, d)
    return C.histogram_correction(f, ["config", "ticker", "horizon"]).select("config", "ticker", "horizon", "bin", "n", R("correction", "correction"))
