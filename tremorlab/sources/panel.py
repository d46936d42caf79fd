"""Price panels: derived from the order tables, read from CSV, or generated."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlab.operators.quantile import quantiles
from tremorlab.session import table

#: Column names that count as the price, in order of preference.
PRICE_NAMES = ("price", "Price", "Close", "close", "Adj Close", "adj_close")


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by return flag: mean, extreme and mid prices and traded quantity.

    One shuffle groups the rows by (ticker, day), combined on the map side; the window that numbers the days works on the small result.
    """
    day = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("date").alias("dt"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("q"))
    bars = day.groupBy("ticker", "dt").agg(F.avg("x").alias("price"), F.max("x").alias("high"), F.min("x").alias("low"), F.sum("q").alias("volume"))
    return numbered(bars.withColumn("open", F.sqrt(F.col("high") * F.col("low"))))


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by order priority."""
    day = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("dt"), F.col("o_totalprice").alias("x"))
    bars = day.groupBy("ticker", "dt").agg(F.avg("x").alias("price"), F.max("x").alias("high"), F.min("x").alias("low"), F.count("*").cast("double").alias("volume"))
    return numbered(bars.withColumn("open", F.sqrt(F.col("high") * F.col("low"))))


def numbered(bars: DataFrame) -> DataFrame:
    """idx: the row's position within its ticker, from 0."""
    return bars.withColumn("idx", (F.row_number().over(Window.partitionBy("ticker").orderBy("dt")) - 1).cast("int"))


def canonical(raw: DataFrame, ticker: str) -> DataFrame:
    """ticker, dt, price and the optional bar columns from a frame with any usual naming; the first column is the date."""
    price = next((c for c in PRICE_NAMES if c in raw.columns), None)
    rest = raw.columns[1:]
    if price is None and len(rest) == 1:
        price = rest[0]
    if price is None:
        raise ValueError(f"no price column among {raw.columns}")
    lower = {c.lower(): c for c in rest}
    bars = [(F.col(f"`{lower[n]}`") if n in lower else F.lit(None)).cast("double").alias(n) for n in ("open", "high", "low", "volume")]
    return raw.select(F.lit(ticker).alias("ticker"), F.to_date(F.col(f"`{raw.columns[0]}`").cast("string")).alias("dt"), F.col(f"`{price}`").cast("double").alias("price"), *bars)


def read_csv(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """A CSV with a header and the date first."""
    return canonical(spark.read.csv(path, header=True), ticker)


def clean(bars: DataFrame, min_rows: int = 0) -> DataFrame:
    """Without null or non-positive prices, one row per (ticker, dt) (the first by price), numbered; fails below ``min_rows`` a ticker."""
    w = Window.partitionBy("ticker", "dt").orderBy("price")
    kept = bars.where("price is not null and dt is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").where("price > 0")
    out = numbered(kept)
    if min_rows:
        short = out.groupBy("ticker").count().where(F.col("count") < min_rows).limit(5).collect()
        if short:
            raise ValueError(f"fewer than {min_rows} rows: {[(r[0], r[1]) for r in short]}")
    return out


def synthetic(spark: SparkSession, tickers: int = 1, days: int = 2520, mu: float = 0.08, sigma: float = 0.2, start: float = 100.0, seed: int = 12345) -> DataFrame:
    """Geometric Brownian motion on weekdays; each ticker and day draws from a hash of (seed, ticker, day), so partitioning does not matter."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "ticker", "step", F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    z = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    weekday = F.expr("date_add(date'2015-01-05', cast(7 * floor(step / 5) + step % 5 as int))")
    rows = spark.range(tickers).select(F.format_string("SYN%05d", "id").alias("ticker"), F.explode(F.sequence(F.lit(0), F.lit(days))).alias("step"))
    step = F.when(F.col("step") > 0, (mu - sigma**2 / 2) / 252 + sigma / math.sqrt(252) * z).otherwise(0.0)
    w = Window.partitionBy("ticker").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    price = F.lit(start) * F.exp(F.sum(step).over(w))
    out = rows.select("ticker", weekday.alias("dt"), price.alias("price"), F.col("step").alias("idx"))
    return out.select("ticker", "dt", "price", *[F.lit(None).cast("double").alias(c) for c in ("open", "high", "low", "volume")], F.col("idx").cast("int").alias("idx"))


def implied_vol_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse volatility table (dt, iv_9d, iv_30d, iv_3m): order amounts of every third day, scaled; some tenors null."""
    day = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("dt")).agg(F.avg("o_totalprice").alias("x"), F.count("*").alias("n"))
    day = day.where("datediff(dt, date'1995-01-01') % 3 = 0")
    return day.select("dt", F.when(F.col("n") % 2 == 0, F.col("x") / 1e6).alias("iv_9d"), (F.col("x") / 9e5).alias("iv_30d"), F.when(F.col("n") % 3 > 0, F.col("x") / 8e5).alias("iv_3m"))


def read_implied_vol(spark: SparkSession, path: str) -> DataFrame:
    """dt, iv_9d, iv_30d, iv_3m from a CSV with index levels in percent (vix9d, vix, vix3m) or decimals (iv_*); rows without any are dropped."""
    raw = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in raw.columns}

    def pick(iv: str, index: str) -> F.Column:
        if iv in names:
            return F.col(f"`{names[iv]}`").cast("double").alias(iv)
        return (F.col(f"`{names[index]}`").cast("double") / 100 if index in names else F.lit(None).cast("double")).alias(iv)

    out = raw.select(F.to_date(F.col(f"`{raw.columns[0]}`").cast("string")).alias("dt"), pick("iv_9d", "vix9d"), pick("iv_30d", "vix"), pick("iv_3m", "vix3m"))
    return out.dropna(how="all", subset=["iv_9d", "iv_30d", "iv_3m"])


def event_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of the largest orders, the top 1 % by amount."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("event_dt"), "o_totalprice")
    cut = quantiles(o, [], "o_totalprice", [0.99]).select(F.col("q")[0].alias("cut"))
    return o.join(F.broadcast(cut), F.col("o_totalprice") >= F.col("cut")).select("event_dt").distinct()


def content_hash(frame: DataFrame) -> DataFrame:
    """One row: an order-free digest of all rows and their count."""
    row = F.xxhash64(*frame.columns).cast("decimal(38,0)")
    return frame.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(row).cast("string")), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
