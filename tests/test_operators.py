import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorlab.functions import scalar
from tremorlab.operators import calibrate, govern, ledger, metrics, online, predict, quality, resample, simulate, study, vol, volfit
from tremorlab.operators import features as X
from tremorlab.operators import lookup as J
from tremorlab.operators.quantile import quantiles
from tremorlab.operators.walkforward import WalkConfig, walk_forward
from tremorlab.sources import panel as P
from tremorlab.sources import store
from tremorlab.streaming import live


@pytest.fixture(scope="module")
def panel(spark):
    return P.synthetic(spark, 2, 700).cache()


def pair_table(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.random(n).round(2)
    y = (rng.random(n) < p).astype(float)
    rows = [("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, y))] + [("g", n, None, 1.0), ("g", n + 1, 0.5, None), ("one", 0, 0.5, 1.0)]
    return spark.createDataFrame(rows, "g string, idx int, p double, y double"), p, y


def test_scores_equal_numpy(spark):
    f, p, y = pair_table(spark)
    b = {r.g: r for r in metrics.basic(f, ["g"]).collect()}
    assert abs(b["g"].brier - np.mean((p - y) ** 2)) < 1e-12 and b["g"].n == len(p)
    assert b["one"].bss is None and b["one"].separation is None
    a = {r.g: r.auc for r in metrics.auc(f, ["g"]).collect()}
    pos, neg = p[y == 1], p[y == 0]
    want = (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / len(pos) / len(neg)
    assert abs(a["g"] - want) < 1e-12 and a["one"] is None
    e = {r.g: r.ece for r in metrics.ece(f, ["g"]).collect()}
    k = np.minimum((p * 10).astype(int), 9)
    assert abs(e["g"] - sum(abs(p[k == i].mean() - y[k == i].mean()) * (k == i).mean() for i in set(k))) < 1e-12
    s = {r.g: r for r in govern.all_scores(f, ["g"]).collect()}
    assert abs(s["g"].auc - want) < 1e-12 and abs(s["g"].ece - e["g"]) < 1e-12 and abs(s["g"].bss - b["g"].bss) < 1e-12
    assert metrics.basic(f.where("false"), ["g"]).count() == 0


def test_crps_and_pit_prefer_the_right_law(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 400)
    from statistics import NormalDist

    def q(s):
        return [s * NormalDist().inv_cdf(v) for v in metrics.LEVELS]

    f = spark.createDataFrame([(float(v), q(1.0), q(5.0)) for v in x], "x double, good array<double>, wide array<double>")
    from pyspark.sql import functions as F

    r = f.select(F.avg(metrics.crps(F.col("good"), F.col("x"))).alias("a"), F.avg(metrics.crps(F.col("wide"), F.col("x"))).alias("b"), F.min(metrics.pit(F.col("good"), F.col("x"))).alias("lo"), F.max(metrics.pit(F.col("good"), F.col("x"))).alias("hi")).first()
    assert r.a < r.b and r.lo == 0.01 and r.hi == 0.99


def test_fdr_keeps_nulls_out(spark):
    f = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.03), ("a", None)], "k string, p_value double")
    got = {r.p_value: r.p_adjusted for r in metrics.fdr(f, ["k"]).collect()}
    assert got[None] is None and abs(got[0.01] - 0.03) < 1e-12 and abs(got[0.04] - 0.04) < 1e-12 and abs(got[0.03] - 0.04) < 1e-12


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    f = spark.createDataFrame([(dt.date(2024, 1, 5), dt.date(2024, 1, 15))], "a date, b date")
    r = f.select(scalar.business_days(F.col("a"), F.col("b")).alias("n"), scalar.norm_cdf(F.lit(1.0)).alias("c"), scalar.t_cdf_5(F.lit(2.015048)).alias("t")).first()
    assert r.n == np.busday_count("2024-01-05", "2024-01-15") and abs(r.c - 0.841344746) < 2e-7 and abs(r.t - 0.95) < 1e-5


def test_quality_checks(spark):
    prices = [100.0] * 6 + [101.0, 50.5, 51.0]
    f = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(i if i < 8 else 60), p, None, None, None) for i, p in enumerate(prices)], "ticker string, dt date, price double, open double, high double, low double")
    f = P.numbered(f)
    assert [(r.start_idx, r.last_idx) for r in quality.stale_runs(f, 5).collect()] == [(0, 6)]
    assert [r.idx for r in quality.split_like(X.with_returns(f)).collect()] == [7]
    assert [r.idx for r in quality.date_gaps(f, 5).collect()] == [8]
    with pytest.raises(ValueError):
        quality.assert_strict(f)


def test_csv_and_cleaning(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close\n2024-01-02,1,2,0.5,1.5\n2024-01-02,1,2,0.5,1.6\n2024-01-03,1,2,0.5,\n2024-01-04,1,2,0.5,-1\n2024-01-05,1,2,0.5,1.7\n")
    f = P.clean(P.read_csv(spark, str(tmp_path / "p.csv"), "x"))
    assert [(r.idx, r.price) for r in f.orderBy("idx").collect()] == [(0, 1.5), (1, 1.7)]
    with pytest.raises(ValueError):
        P.clean(f.drop("idx"), 10)
    (tmp_path / "v.csv").write_text("date,VIX,VIX9D\n2024-01-02,20,15\n2024-01-03,,\n")
    assert [tuple(r) for r in P.read_implied_vol(spark, str(tmp_path / "v.csv")).collect()] == [(dt.date(2024, 1, 2), 0.15, 0.2, None)]


def test_as_of_crosses_years_and_nulls(spark):
    left = spark.createDataFrame([(i, dt.date(2019, 1, 1) + dt.timedelta(200 * i)) for i in range(8)], "i int, dt date")
    right = spark.createDataFrame([(dt.date(2019, 3, 1), 1.0), (dt.date(2020, 12, 31), 2.0)], "dt date, v double")
    got = {r.i: r.found.v if r.found else None for r in J.as_of(left, right).collect()}
    assert got == {0: None, 1: 1.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 2.0, 6: 2.0, 7: 2.0}


def test_event_lookups_equal_brute_force(spark, panel):
    days = [r.dt for r in panel.where("ticker = 'SYN00000'").orderBy("dt").collect()]
    events = [days[5], days[40], days[41], days[300]]
    ev = spark.createDataFrame([(e,) for e in events], "event_dt date")
    got = {(r.ticker, r.idx): r.n_events for r in J.event_count(panel, ev, 10).collect()}
    near = {(r.ticker, r.idx): r.proximity for r in J.nearest_event(panel, ev).collect()}
    for i, day in enumerate(days):
        end = days[min(i + 10, len(days) - 1)]
        assert got[("SYN00000", i)] == sum(day <= e <= end for e in events)
        assert abs(near[("SYN00000", i)] - max(0, 1 - min(abs((e - day).days) for e in events) / 20)) < 1e-12


def test_garch_recovers_parameters_and_falls_back():
    rng = np.random.default_rng(5)
    h, r = 1e-4, []
    for _ in range(3000):
        x = math.sqrt(h) * rng.standard_normal()
        r.append(x)
        h = 5e-6 + 0.1 * x * x + 0.85 * h
    f = volfit.fit_garch(np.array(r))
    assert abs(f["alpha"] - 0.1) < 0.05 and abs(f["alpha"] + f["beta"] - 0.95) < 0.05 and f["source"] == "garch"
    assert volfit.fit_garch(np.array(r[:50]))["source"] == "ewma" and volfit.fit_garch(np.zeros(500))["source"] == "ewma"
    assert volfit.fit_garch(np.array(r), "gjr")["source"] == "gjr"


def test_gaussian_simulation_equals_the_closed_form():
    from statistics import NormalDist

    sigma, h, tau, m = 0.02, 10, 0.06, 200_000
    ret = simulate.terminal_returns(np.random.default_rng(0), sigma, h, m)
    s = sigma * math.sqrt(h)
    nd = NormalDist(-s * s / 2, s)
    want = 1 - nd.cdf(math.log(1 + tau)) + nd.cdf(math.log(1 - tau))
    p, se, lo, hi, n, q = simulate.move_probability(ret, tau)
    assert abs(p - want) < 4 * se and lo <= p <= hi and n == m and sorted(q) == q
    garch = simulate.terminal_returns(np.random.default_rng(0), sigma, h, m, omega=sigma * sigma, alpha=0.0, beta=0.0)
    assert abs(np.std(garch) - np.std(ret)) < 1e-4
    jump = simulate.terminal_returns(np.random.default_rng(0), sigma, h, m, jumps=(20.0, -0.05, 0.05))
    assert np.mean(np.abs(jump) >= 0.15) > np.mean(np.abs(ret) >= 0.15) and abs(jump.mean()) < 2e-3


def test_seeds_do_not_depend_on_partitions(spark):
    f = spark.createDataFrame([("a", i, 5, 0.02, 0.05) for i in range(30)] + [("a", 99, 5, None, 0.05)], "ticker string, idx int, horizon int, sigma_1d double, tau double")
    a, b = ({r.idx: r.p_raw for r in simulate.simulate(f.repartition(n), 500).collect()} for n in (1, 5))
    assert a == b and a[99] is None


def test_walk_has_no_lookahead(spark, panel):
    tau = spark.createDataFrame([(5, 0.05), (10, 0.07)], "horizon int, tau double")
    cfg = WalkConfig(paths=200, refit_every=60)
    short = {(r.ticker, r.idx, r.horizon): (r.p_raw, r.p_cal) for r in walk_forward(panel.where("idx <= 500"), cfg, tau).collect()}
    full = {(r.ticker, r.idx, r.horizon): (r.p_raw, r.p_cal, r.y) for r in walk_forward(panel, cfg, tau).collect()}
    assert short and all(np.allclose(full[k][:2], v, atol=1e-10) for k, v in short.items())
    assert all(v[2] is None for k, v in full.items() if k[1] > 700 - k[2])
    with pytest.raises(ValueError):
        WalkConfig.of({"paths": 1, "unknown": 2})


def test_daily_volatility_follows_the_last_fit(spark, panel):
    """Stretches of a series give the fits and recursions of the series as a whole."""
    r = X.with_returns(panel).select("ticker", "idx", "ret")
    whole = {(x.ticker, x.idx): x for x in volfit.garch_series(r, 50, daily=True, chunk=100_000).collect()}
    parts = {(x.ticker, x.idx): x for x in volfit.garch_series(r, 50, daily=True, chunk=90).collect()}
    assert whole.keys() == parts.keys() and all(np.isclose(whole[k].sigma_1d, parts[k].sigma_1d, rtol=1e-9) for k in whole)
    ret = {(x.ticker, x.idx): x.ret for x in r.collect()}
    for (t, i), x in whole.items():
        if x.source == "garch" and i % 50 and (t, i - 1) in whole:
            h = x.omega + (x.alpha + x.gamma * (ret[t, i] < 0)) * ret[t, i] ** 2 + x.beta * whole[t, i - 1].sigma_1d ** 2
            assert np.isclose(x.sigma_1d, min(1.0, math.sqrt(h)))


def test_prediction_from_states_equals_the_walk(spark, panel):
    f = X.vol_state(X.with_returns(panel))
    f = X.label_moves(X.forward_returns(f), spark.createDataFrame([(5, 0.02), (10, 0.03)], "horizon int, tau double"))
    f = f.where("idx >= 252").withColumn("p", F.lit(0.05) + F.pmod(F.col("idx"), F.lit(7)) / 20.0)
    walked = online.calibrate(f).collect()
    last = {(r.ticker, r.horizon): max((x for x in walked if (x.ticker, x.horizon) == (r.ticker, r.horizon)), key=lambda x: x.idx) for r in walked}
    states = online.train_states(f).collect()
    feats = {(r.ticker, r.idx): [r[c] for c in online.FEATURES] for r in f.collect()}
    assert len(states) == len(last) > 0
    for r in states:
        x = last[r.ticker, r.horizon]
        assert abs(online.emit(json.loads(r.state), x.p, feats[r.ticker, x.idx]) - x.p_cal) < 1e-12
    tau = spark.createDataFrame([(5, 0.02), (10, 0.03)], "horizon int, tau double")
    got = predict.predict_latest(panel, spark.createDataFrame(states), tau, paths=500).collect()
    assert {(r.ticker, r.horizon) for r in got} == set(last)
    assert all(0 <= r.p_raw <= 1 and 0 <= r.p_cal <= 1 and r.sigma_1d > 0 and r.n_updates > 0 for r in got)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in rng.normal(size=30_000)] + [("b", float(x)) for x in rng.integers(0, 5, 20_000)] + [("c", 7.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    f = spark.createDataFrame(rows, "k string, x double")
    qs = [0.0, 0.01, 0.33, 0.5, 0.97, 1.0]
    got = {r.k: r.q for r in quantiles(f, ["k"], "x", qs).collect()}
    for k in "abce":
        assert np.allclose(got[k], np.quantile([x for g, x in rows if g == k], qs), atol=1e-12)
    assert got["d"] is None
    assert np.allclose(quantiles(f, [], "x", [0.8]).first().q, np.quantile([x for _, x in rows if x is not None], 0.8))


def test_ewma_equals_the_recursion(spark):
    rng = np.random.default_rng(5)
    ret = [None, *rng.normal(0, 0.02, 1500).tolist()]
    f = spark.createDataFrame([("a", i, dt.date(2000, 1, 1) + dt.timedelta(i), x) for i, x in enumerate(ret)], "ticker string, idx int, dt date, ret double")
    got = {r.idx: r.ewma for r in X.ewma_vol(f).collect()}
    s = w = 0.0
    assert got[0] is None
    for i, x in enumerate(ret[1:], 1):
        s, w = s * (1 - 2 / 21) + x * x, w * (1 - 2 / 21) + 1
        assert abs(got[i] - math.sqrt(s / w)) < 1e-12


def test_platt_fold_equals_numpy(spark):
    f, p, y = pair_table(spark, 400)
    a, b = 1.0, 0.0
    for n, (q, t) in enumerate(zip(p, y)):
        x = math.log(min(max(q, 1e-7), 1 - 1e-7) / (1 - min(max(q, 1e-7), 1 - 1e-7)))
        out = q if n < 50 else 1 / (1 + math.exp(-(a * x + b)))
        a, b = a - 0.05 / math.sqrt(1 + n) * (out - t) * x, b - 0.05 / math.sqrt(1 + n) * (out - t)
    r = calibrate.platt_fold(f.where("g = 'g'"), ["g"]).first()
    assert abs(r.a - a) < 1e-9 and abs(r.b - b) < 1e-9 and r.n == 400


def test_pair_average_sweeps(spark):
    from pyspark.sql import functions as F

    def model(v, sweeps):
        v = list(v)
        for _ in range(sweeps):
            for i in range(len(v) - 1):
                if v[i] > v[i + 1]:
                    v[i] = v[i + 1] = (v[i] + v[i + 1]) / 2
        return v

    vals = [0.3, 0.1, 0.5, 0.4, 0.2, 0.9]
    got = spark.createDataFrame([(vals,)], "v array<double>").select(calibrate.pair_average(F.col("v"), 6).alias("r")).first().r
    assert np.allclose(got, model(vals, 6))


def test_online_calibrator_improves_biased_probabilities_and_restores():
    rng = np.random.default_rng(3)
    n = 3000
    y = (rng.random(n) < 0.15).astype(float)
    p = np.clip(rng.normal(0.30, 0.08, n), 0.01, 0.99)
    g = pd.DataFrame({"ticker": "a", "idx": np.arange(n), "horizon": 5, "p": p, "y": y, **{c: 0.0 for c in online.FEATURES}})
    for kind in ("multi", "regime"):
        out = online.walk(g, 5, kind)
        assert ((out.p_cal - out.y) ** 2).mean() < ((out.p - out.y) ** 2).mean()
        assert (out.p_model[:100] == out.p[:100]).all()
    m = online.OnlineLogistic(3, warm_up=5)
    for i in range(300):
        m.update(p[i], np.array([1.0, 0.5, 0.1]), y[i])
    again = online.OnlineLogistic.restore(m.state())
    assert again.state() == m.state() and again.emit(0.3, np.array([1.0, 0.5, 0.1])) == m.emit(0.3, np.array([1.0, 0.5, 0.1]))


def test_bootstrap_and_intervals(spark):
    rng = np.random.default_rng(2)
    f = spark.createDataFrame([("better", i, float(v)) for i, v in enumerate(rng.normal(-0.1, 0.2, 300))] + [("same", i, float(v)) for i, v in enumerate(rng.normal(0, 0.2, 300))] + [("few", 0, 1.0)], "k string, idx int, diff double")
    p = {r.k: r.p_value for r in resample.paired_pvalue(f, ["k"], block=5).collect()}
    assert p["better"] < 0.01 < p["same"] and p["few"] is None
    g, _, _ = pair_table(spark)
    r = {x.g: x for x in resample.metric_intervals(g, ["g"]).collect()}
    assert r["g"].ci_low < r["g"].value < r["g"].ci_high
    i = resample.block_indices(np.random.default_rng(0), 10, 3, 4)
    assert i.shape == (4, 10) and ((np.diff(i[:, :3]) % 10) == 1).all()


def test_projection_and_term_structure(spark):
    from pyspark.sql import functions as F

    f = spark.createDataFrame([(1e-6, 0.2, 0.9, 0.0, 1e-4)], "omega double, alpha double, beta double, gamma double, anchor_var double")
    r = vol.project(f).first()
    assert r.projected and abs(r.alpha + r.beta - 0.98) < 1e-12 and abs(r.omega - 1e-4 * 0.02) < 1e-15
    t = f.select(vol.term_structure(F.lit(0.02), F.lit(0.01), F.lit(0.9), F.lit(3)).alias("s")).first().s
    want = math.sqrt(np.mean([1e-4 + 0.9**k * (4e-4 - 1e-4) for k in (1, 2, 3)]))
    assert abs(t - want) < 1e-12


def test_pooled_logistic_finds_the_weights(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(float)
    f = spark.createDataFrame([(float(a), float(b), 0.5) for a, b in zip(x, y)], "x double, y double, p double")
    w = study.pooled_logistic(f, ["x"], l2=1e-6)
    assert abs(w[0] - 0.5) < 0.15 and abs(w[1] - 1.5) < 0.2
    assert study.pooled_logistic(f.limit(5), ["x"]).tolist() == [0.0, 1.0]


def test_ledger_is_append_only_and_anchored(spark, tmp_path):
    path = str(tmp_path / "f")
    row = lambda i: ("id%d" % i, "t", "v", "c", "d", dt.date(2024, 1, 1), 5, None, 1.0, 0.05, 0.01, 0.1, 0.1)
    make = lambda ids: spark.createDataFrame([row(i) for i in ids], ledger.FORECAST)
    assert ledger.append(spark, make([1, 2, 2]), path, ledger.FORECAST) == 2
    mark = ledger.anchor(spark, {"f": path})
    assert ledger.append(spark, make([2, 1]), path, ledger.FORECAST) == 0 and ledger.verify_anchor(spark, mark, {"f": path})
    assert ledger.append(spark, make([3]), path, ledger.FORECAST) == 1 and not ledger.verify_anchor(spark, mark, {"f": path})
    res = ledger.load(spark, str(tmp_path / "none"), ledger.RESOLUTION)
    assert res.count() == 0 and ledger.pending(ledger.load(spark, path, ledger.FORECAST), res).count() == 3


def test_state_cache_and_manifest(spark, tmp_path):
    s = {("a", 5): {"w": [1.0, 2.0]}, ("b", 10): {"n": 3}}
    store.save_state(spark, s, str(tmp_path / "s"))
    assert store.load_state(spark, str(tmp_path / "s")) == s
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert store.cached(spark, str(tmp_path / "c"), make, 1000).count() == 3
    assert len(made) == 1 and store.manifest(spark, str(tmp_path / "c")).count() >= 1


def test_stream_equals_batch_and_continues(spark, panel, tmp_path):
    src = panel.select("ticker", "dt", "price")
    src.where("idx < 300").write.parquet(str(tmp_path / "in"))
    run = lambda: live.run_available(live.resolve_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), 5), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    src.where("idx >= 300").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = sorted((r.ticker, r.dt, r.resolved_dt, round(r.realized_return, 12)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = J.resolve_by_position(panel.select("ticker", "dt").crossJoin(spark.createDataFrame([(5,)], "horizon int")), panel)
    assert got == sorted((r.ticker, r.dt, r.resolved_dt, round(r.realized_return, 12)) for r in want.collect())
