"""Inputs that many queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlab.functions import scalar
from tremorlab.operators import features as X
from tremorlab.plans.registry import cte
from tremorlab.sources import panel as P


def R(c: Column | str, name: str) -> Column:
    """Rounded to six digits for comparison, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def panel(spark: SparkSession, d: str) -> DataFrame:
    return P.from_lineitem(spark, d)


def rets(spark: SparkSession, d: str) -> DataFrame:
    return X.with_returns(panel(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    f = X.forward_returns(rets(spark, d))
    return X.label_moves(f, X.adaptive_thresholds(f))


def state(spark: SparkSession, d: str) -> DataFrame:
    return X.regime(X.percentile_rank(X.vol_state(rets(spark, d))))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Rows from idx 252 with label y, trailing base rate and a normal-law probability p from realized volatility."""
    s = X.regime(X.percentile_rank(X.vol_state(rets(spark, d))))
    f = X.forward_returns(s)
    f = X.rolling_base_rate(X.label_moves(f, X.adaptive_thresholds(f)))
    z = F.col("tau") / (F.greatest("vol_20", F.lit(1e-8)) * F.sqrt("horizon"))
    return f.where("idx >= 252").withColumn("p", F.greatest(F.lit(0.001), F.least(F.lit(0.999), 2 * (1 - scalar.norm_cdf(z)))))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(config, ticker, idx, dt, horizon, p, y, ret_h, sigma, regime): two configurations, base and normal, in long form."""
    s = scored(spark, d)
    both = F.explode(F.array(F.struct(F.lit("base").alias("config"), F.col("base").alias("p")), F.struct(F.lit("normal").alias("config"), F.col("p").alias("p"))))
    keep = ["ticker", "idx", "dt", "horizon", "y", "ret_h", "tau", "vol_20", "regime"]
    return s.select(*keep, both.alias("c")).select("c.config", *keep, "c.p")


def price_sql(table: str, ticker: str, day: str, x: str, q: str) -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS INTEGER) AS idx FROM (
 SELECT {ticker} AS ticker, CAST({day} AS DATE) AS dt, avg({x}) AS price, max({x}) AS high, min({x}) AS low, sqrt(max({x}) * min({x})) AS open, {q} AS volume FROM {table} GROUP BY 1, 2)"""


WT = "(PARTITION BY ticker ORDER BY dt)"
cte("panel", price_sql("lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", "sum(l_quantity)"))
cte("panel2", price_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "CAST(count(*) AS DOUBLE)"))
cte("rets", f"SELECT *, price / lag(price) OVER {WT} - 1 AS ret, ln(price / lag(price) OVER {WT}) AS log_ret FROM panel")
cte("rets2", f"SELECT *, price / lag(price) OVER {WT} - 1 AS ret FROM panel2")
cte("vol20", "SELECT *, CASE WHEN count(ret) OVER l20 = 20 THEN stddev_pop(ret) OVER l20 END AS vol_20, stddev_pop(ret) OVER past AS sigma FROM rets WINDOW l20 AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), past AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
cte(
    "vstate",
    f"""SELECT *, CASE WHEN vol_20 IS NULL OR sigma <= 0 THEN 1.0 ELSE vol_20 / sigma END AS vol_ratio,
 coalesce(vol_20 - lag(vol_20, 20) OVER {WT}, 0.0) AS delta_sigma,
 CASE WHEN count(vol_20) OVER l60 = 60 THEN stddev_pop(vol_20) OVER l60 ELSE 0.0 END AS vol_of_vol,
 count(vol_20) OVER past AS known,
 list(vol_20) FILTER (vol_20 IS NOT NULL) OVER l252 AS seen
 FROM vol20 WINDOW l60 AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
 l252 AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW),
 past AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
cte("vpct", "SELECT * EXCLUDE (seen), CASE WHEN vol_20 IS NOT NULL THEN len(list_filter(seen, lambda x: x < vol_20)) / len(seen) END AS pct FROM vstate")
cte("state", "SELECT *, CASE WHEN known < 252 OR pct IS NULL THEN 'mid' WHEN pct < 0.25 THEN 'low' WHEN pct > 0.75 THEN 'high' ELSE 'mid' END AS regime FROM vpct")
cte("ahead", f"SELECT *, unnest([5, 10]) AS horizon, unnest([lead(price, 5) OVER {WT} / price - 1, lead(price, 10) OVER {WT} / price - 1]) AS ret_h FROM state")
cte("taus", "SELECT horizon, quantile_cont(abs(ret_h), 0.8) AS tau FROM ahead WHERE ret_h IS NOT NULL GROUP BY horizon")
cte("labelled", "SELECT ahead.*, tau, CASE WHEN ret_h IS NULL THEN NULL WHEN abs(ret_h) >= tau THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM ahead JOIN taus USING (horizon)")
cte(
    "based",
    """SELECT *, coalesce(CASE WHEN horizon = 5 THEN avg(y) OVER (PARTITION BY ticker, horizon ORDER BY dt ROWS BETWEEN 252 PRECEDING AND 6 PRECEDING)
 ELSE avg(y) OVER (PARTITION BY ticker, horizon ORDER BY dt ROWS BETWEEN 252 PRECEDING AND 11 PRECEDING) END, 0.0) AS base FROM labelled""",
)
cte("scored", f"SELECT *, greatest(0.001, least(0.999, 2 * (1 - {scalar.norm_cdf_sql('(tau / (greatest(vol_20, 1e-8) * sqrt(horizon)))')}))) AS p FROM based WHERE idx >= 252")
cte("pairs", "SELECT 'base' AS config, ticker, idx, dt, horizon, y, ret_h, tau, vol_20, regime, base AS p FROM scored UNION ALL SELECT 'normal', ticker, idx, dt, horizon, y, ret_h, tau, vol_20, regime, p FROM scored")
cte("known", "SELECT * FROM pairs WHERE y IS NOT NULL AND p IS NOT NULL")
