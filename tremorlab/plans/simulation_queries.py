"""Queries that fit, simulate, resample or stream; SQL cannot express them, tests hold them against models of their own."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from tremorlab.functions import scalar
from tremorlab.operators import calibrate
from tremorlab.operators import features as X
from tremorlab.operators import govern as G
from tremorlab.operators import metrics as M
from tremorlab.operators import online, predict, resample, simulate, study, volfit
from tremorlab.operators.quantile import quantiles
from tremorlab.operators.walkforward import WalkConfig, walk_forward
from tremorlab.plans import governance_queries  # noqa: F401  its sub-queries are used here
from tremorlab.plans.base import WT, R, labelled, pairs, panel, rets, scored, state
from tremorlab.plans.registry import cte, query, r6
from tremorlab.sources import store
from tremorlab.streaming import live


@query()
def garch_fit(spark, d):
    return volfit.garch_series(rets(spark, d), 21, "garch")


@query()
def garch_ensemble(spark, d):
    return volfit.garch_series(rets(spark, d), 252, "ensemble")


def _har_sql(value: str, source: str) -> str:
    """HAR regressions as SQL: normal equations by sums, solved by Cramer's rule in units of each column's root mean square."""
    x = ["1.0::DOUBLE", "rv_1", "rv_5", "rv_22"]
    past = lambda n: f"avg(v) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    ahead = lambda n: f"avg(v) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    rows = f"SELECT ticker, idx, v AS rv_1, {past(5)} AS rv_5, {past(22)} AS rv_22, {ahead(1)} AS t1, {ahead(5)} AS t5, {ahead(22)} AS t22, count(ret) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 22 FOLLOWING) AS c FROM (SELECT *, {value} AS v FROM {source})"
    long = f"SELECT ticker, rv_1, rv_5, rv_22, unnest([1, 5, 22]) AS target, unnest([t1, t5, t22]) AS y FROM ({rows}) WHERE idx >= 22 AND c = 22"
    sums = ", ".join([f"sum({x[i]} * {x[j]}) AS m{i}{j}" for i in range(4) for j in range(i, 4)] + [f"sum({x[i]} * y) AS v{i}" for i in range(4)])
    raw = f"SELECT ticker, target, count(*) AS n, sum(y * y) AS yy, {sums} FROM ({long}) GROUP BY ALL HAVING count(*) >= 44"
    scale = ", ".join(f"sqrt(greatest(m{i}{i} / n, 1e-300)) AS s{i}" for i in range(4))
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    entries = ", ".join([f"{m(i, j)} / s{i} / s{j}{' + 0.0001 * n' if i == j and i else ''} AS a{i}{j}" for i in range(4) for j in range(4)] + [f"v{i} / s{i} AS c{i}" for i in range(4)])

    def det(cell) -> str:
        terms = []
        for p in permutations(range(4)):
            sign = -1 if sum(p[a] > p[b] for a in range(4) for b in range(a + 1, 4)) % 2 else 1
            terms.append(f"{'-' if sign < 0 else '+'} " + " * ".join(cell(i, p[i]) for i in range(4)))
        return f"({' '.join(terms)})"

    a = lambda i, j: f"a{i}{j}"
    weights = ", ".join(f"{det(lambda i, j, k=k: f'c{i}' if j == k else a(i, j))} / {det(a)} / s{k} AS w{k}" for k in range(4))
    sse = "yy - 2 * (w0 * v0 + w1 * v1 + w2 * v2 + w3 * v3) + " + " + ".join(f"w{i} * w{j} * {m(i, j)}" for i in range(4) for j in range(4))
    out = ", ".join(f"{r6(f'w{k}')} AS {name}" for k, name in enumerate(("b0", "b1", "b5", "b22")))
    return f"SELECT ticker, target, n, {out}, {r6(f'CASE WHEN yy - v0 * v0 / n > 0 THEN 1 - ({sse}) / (yy - v0 * v0 / n) ELSE 0.0 END')} AS r2 FROM (SELECT *, {weights} FROM (SELECT *, {entries} FROM (SELECT *, {scale} FROM ({raw}))))"


def _har(f):
    return f.select("ticker", "target", "n", *[R(c, c) for c in ("b0", "b1", "b5", "b22", "r2")])


@query(_har_sql("ret * ret", "rets"))
def har_rv(spark, d):
    return _har(volfit.har_rv(rets(spark, d)))


@query(_har_sql("pow(ln(high / low), 2) / (4 * ln(2.0)) + ret * ret + coalesce(g * g, 0.0)", f"(SELECT *, ln(open / lag(price) OVER {WT}) AS g FROM rets)"))
def har_ohlc(spark, d):
    f = X.range_features(rets(spark, d))
    value = F.col("parkinson") + F.col("ret") * F.col("ret") + F.coalesce("gap_var", F.lit(0.0))
    return _har(volfit.har_rv(f, value=value))


@query()
def garch_cdf_baseline(spark, d):
    """2 T(-tau / scale) with the latest fit's volatility and 5 degrees of freedom."""
    f = volfit.carry_forward(scored(spark, d).where("horizon = 5"), volfit.garch_series(rets(spark, d), 21))
    scale = F.col("sigma_1d") * F.sqrt("horizon") * (3.0 / 5.0) ** 0.5
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * scalar.t_cdf_5(-F.col("tau") / scale)))
    return f.where("sigma_1d is not null").select("ticker", "idx", "horizon", "y", p.alias("p"))


@query()
def mc_regime_tails(spark, d):
    f = simulate.regime_df(X.percentile_rank(scored(spark, d).drop("pct")))
    return simulate.simulate(f.select("ticker", "idx", "horizon", F.col("vol_20").alias("sigma_1d"), "tau", "t_df"), 1000)


@query(f"""SELECT ticker, {r6('avg(abs(a - pa)) FILTER (n > m - 50)')} AS velocity, {r6('max(a) FILTER (n > m - 100) - min(a) FILTER (n > m - 100)')} AS spread FROM
 (SELECT *, lag(a) OVER (PARTITION BY ticker ORDER BY n) AS pa, max(n) OVER (PARTITION BY ticker) AS m FROM platt_walk) GROUP BY ticker""")
def convergence_velocity(spark, d):
    s = scored(spark, d).where("horizon = 5 and y is not null and p is not null")
    return calibrate.convergence(calibrate.platt_trace(s, ["ticker"]), ["ticker"]).select("ticker", R("velocity", "velocity"), R("spread", "spread"))


@query()
def mc_gbm(spark, d):
    f = scored(spark, d).select("ticker", "idx", "horizon", F.col("vol_20").alias("sigma_1d"), "tau", "p")
    return simulate.simulate(f, 1000, df=None)


@query()
def mc_garch_jumps(spark, d):
    f = scored(spark, d).select("ticker", "idx", "horizon", F.col("vol_20").alias("sigma_1d"), "tau", (0.02 * F.col("vol_20") * F.col("vol_20")).alias("omega"), F.lit(0.08).alias("alpha"), F.lit(0.88).alias("beta"), F.lit(0.04).alias("gamma"), F.lit(2.0).alias("jump_rate"), F.lit(-0.02).alias("jump_mean"), F.lit(0.04).alias("jump_dev"))
    return simulate.simulate(f, 1000)


@query()
def mf_calibration(spark, d):
    return online.calibrate(scored(spark, d), "multi")


@query()
def predict_latest(spark, d):
    """The last day of each ticker by calibrators trained on all that was known by then."""
    p = panel(spark, d)
    return predict.predict_latest(p, online.train_states(scored(spark, d)), X.adaptive_thresholds(X.forward_returns(p)))


@query()
def regime_mf_calibration(spark, d):
    return online.calibrate(scored(spark, d), "regime")


@query()
def walkforward(spark, d):
    return walk_forward(panel(spark, d), WalkConfig(paths=10_000, refit_every=21)).drop("q")


@query()
def walkforward_scores(spark, d):
    w = walk_forward(panel(spark, d), WalkConfig(paths=1000, refit_every=21, kind="regime", jumps=True))
    both = F.explode(F.array(F.struct(F.lit("raw").alias("config"), F.col("p_raw").alias("p")), F.struct(F.lit("cal").alias("config"), F.col("p_cal").alias("p")))).alias("c")
    return G.all_scores(w.select("horizon", "y", both).select("*", "c.*"), ["config", "horizon"])


@query()
def ablation(spark, d):
    p = panel(spark, d)
    variants = {"gbm": WalkConfig(t_df=None), "student_t": WalkConfig(), "jumps": WalkConfig(jumps=True)}
    from functools import reduce

    from tremorlab.operators.walkforward import forecasts

    parts = [forecasts(p, c).select(F.lit(n).alias("config"), "ticker", "idx", "horizon", "y", F.col("p_raw").alias("p")) for n, c in variants.items()]
    return G.all_scores(reduce(lambda a, b: a.unionByName(b), parts), ["config", "horizon"])


@query()
def seed_stability(spark, d):
    f = scored(spark, d).select("ticker", "idx", "horizon", F.col("vol_20").alias("sigma_1d"), "tau")
    from functools import reduce

    parts = [simulate.simulate(f, 500, seed=s).select("ticker", "idx", "horizon", F.lit(s).alias("seed"), "p_raw") for s in (1, 2, 3)]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("ticker", "idx", "horizon").agg(F.avg("p_raw").alias("mean"), F.stddev_samp("p_raw").alias("sd"))


@query()
def bootstrap_pvalue(spark, d):
    f = M.valid(pairs(spark, d)).groupBy("ticker", "idx", "horizon").agg((F.max(F.when(F.col("config") == "normal", F.pow(F.col("p") - F.col("y"), 2))) - F.max(F.when(F.col("config") == "base", F.pow(F.col("p") - F.col("y"), 2)))).alias("diff"))
    return M.fdr(resample.paired_pvalue(f, ["ticker", "horizon"], block=5, rounds=300), ["horizon"])


@query()
def bca_ci(spark, d):
    return resample.metric_intervals(pairs(spark, d), ["config", "ticker", "horizon"], "bss", rounds=200)


@query()
def ece_ci(spark, d):
    return resample.metric_intervals(pairs(spark, d), ["config", "ticker", "horizon"], "ece", block=5, rounds=200)


@query()
def pooled_calibrator(spark, d):
    f = study.logit_column(scored(spark, d))
    cut = F.col("idx") < 1200
    w = study.pooled_logistic(f.where(cut & (F.col("idx") + F.col("horizon") < 1200)), ["x_logit", "vol_ratio"])
    return study.apply_logistic(f.where(~cut), ["x_logit", "vol_ratio"], w).select("ticker", "idx", "horizon", "y", "p", "p_cal")


@query()
def feature_logistic_baseline(spark, d):
    f = X.strided_features(rets(spark, d))
    f = X.forward_returns(f)
    f = X.rolling_base_rate(X.label_moves(f, X.adaptive_thresholds(f)))
    return study.online_logistic_baseline(f.where("idx >= 252"))


@query()
def gbt_baseline(spark, d):
    s = scored(spark, d).where("horizon = 5")
    split = s.agg(F.max("idx")).first()[0] * 2 // 3
    return study.boosted_baseline(s, split, ["vol_20", "vol_ratio", "delta_sigma", "vol_of_vol"], trees=5)


@query()
def parameter_search(spark, d):
    return study.as_table(spark, study.search(labelled(spark, d)))


@query()
def price_path_table(spark, d):
    return simulate.path_table(spark, 0.01, 10, 500)


@query(f"SELECT CAST(ticker AS VARCHAR) AS ticker, CAST(dt AS DATE) AS dt, 5 AS horizon, CAST(lead(dt, 5) OVER {WT} AS DATE) AS resolved_dt, {r6(f'lead(price, 5) OVER {WT} / price - 1')} AS realized_return FROM panel QUALIFY lead(dt, 5) OVER {WT} IS NOT NULL")
def stream_resolve(spark, d):
    """The panel as a stream of files, resolved with state and written to a sink."""
    at = store.work_dir(spark, "resolve")
    src = panel(spark, d).select("ticker", "dt", "price")
    src.repartitionByRange(3, "dt").sortWithinPartitions("dt").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{at}/in")
    live.run_available(live.resolve_stream(stream, 5), f"{at}/out", f"{at}/progress")
    out = spark.read.schema(live.RESOLVED).parquet(f"{at}/out")
    return out.select("ticker", "dt", "horizon", "resolved_dt", R("realized_return", "realized_return"))


def _events_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


# a window is out once the watermark, an hour behind the last event, has passed its end
@query(f"""SELECT strftime(date_trunc('hour', CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, {r6('sum(value)')} AS total FROM events
GROUP BY date_trunc('hour', CAST(ts AS TIMESTAMP)), event_type HAVING date_trunc('hour', CAST(ts AS TIMESTAMP)) + INTERVAL 2 HOUR <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events)""")
def stream_tumbling(spark, d):
    at = store.work_dir(spark, "tumbling")
    live.run_available(live.tumbling(_events_stream(spark, d)), f"{at}/out", f"{at}/progress")
    return spark.read.parquet(f"{at}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", R("total", "total"))


@query("""SELECT user_id, strftime(min(t), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(t) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n FROM (
 SELECT *, sum(CASE WHEN t - before <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM (
  SELECT user_id, CAST(ts AS TIMESTAMP) AS t, lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events))
GROUP BY user_id, session HAVING max(t) + INTERVAL 90 MINUTE <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events)""")
def stream_sessions(spark, d):
    at = store.work_dir(spark, "sessions")
    live.run_available(live.sessions(_events_stream(spark, d)), f"{at}/out", f"{at}/progress")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return spark.read.parquet(f"{at}/out").select("user_id", stamp("start"), stamp("end"), "n")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'signup'")
def stream_publish_once(spark, d):
    at = store.work_dir(spark, "publish")
    e = _events_stream(spark, d).where("event_type = 'signup'").withColumn("forecast_id", F.col("event_id").cast("string"))
    twice = e.withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_k")
    live.run_available(live.publish_once(twice), f"{at}/out", f"{at}/progress")
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id")


cte("chart_hist", "SELECT ticker, width AS bin, count(*) AS n FROM (SELECT ticker, CAST(least(49, floor((ret - lo) / (hi - lo) * 50)) AS INTEGER) AS width FROM rets JOIN (SELECT ticker, min(ret) AS lo, max(ret) AS hi FROM rets GROUP BY ticker) USING (ticker) WHERE ret IS NOT NULL) GROUP BY ALL")


@query("SELECT * FROM chart_hist")
def chart_return_histogram(spark, d):
    r = rets(spark, d).where("ret is not null")
    lim = r.groupBy("ticker").agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    b = F.least(F.lit(49), F.floor((F.col("ret") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 50)).cast("int")
    return r.join(F.broadcast(lim), "ticker").groupBy("ticker", b.alias("bin")).agg(F.count("*").alias("n"))


@query(f"SELECT ticker, idx, {r6('vol_20')} AS vol_20, CASE WHEN vol_20 >= q[2] THEN 'high' WHEN vol_20 <= q[1] THEN 'low' ELSE 'mid' END AS zone FROM vol20 JOIN (SELECT ticker, quantile_cont(vol_20, [0.25, 0.75]) AS q FROM vol20 GROUP BY ticker) USING (ticker) WHERE vol_20 IS NOT NULL")
def chart_vol_zones(spark, d):
    s = X.vol_state(rets(spark, d)).where("vol_20 is not null")
    q = s.groupBy("ticker").agg(F.percentile("vol_20", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    zone = F.when(F.col("vol_20") >= F.col("q")[1], "high").when(F.col("vol_20") <= F.col("q")[0], "low").otherwise("mid")
    return s.join(F.broadcast(q), "ticker").select("ticker", "idx", R("vol_20", "vol_20"), zone.alias("zone"))


cte("matrix", "SELECT dt, horizon, avg(p) AS p FROM scored GROUP BY ALL")


@query(f"SELECT dt, horizon, {r6('least(p, (SELECT quantile_cont(p, 0.97) FROM matrix))')} AS p FROM matrix")
def chart_heat_map(spark, d):
    cells = scored(spark, d).groupBy("dt", "horizon").agg(F.avg("p").alias("p"))
    top = quantiles(cells, [], "p", [0.97]).select(F.col("q")[0].alias("top"))
    return cells.join(F.broadcast(top)).select("dt", "horizon", R(F.least("p", "top"), "p"))


@query("SELECT regime, count(*) AS n FROM state GROUP BY ALL")
def regime_counts(spark, d):
    return state(spark, d).groupBy("regime").agg(F.count("*").alias("n"))
