"""As-of, nearest-event, interval-count and positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlab.functions.scalar import business_days


def as_of(left: DataFrame, right: DataFrame, key: str = "dt", by: list[str] | None = None, name: str = "found") -> DataFrame:
    """``left`` with a struct of the latest ``right`` row at or before each row's key, null where there is none.

    Both sides are unioned and the last right row is carried forward in key order: one sort, no range
    join, however long the history. Without ``by`` the time axis is first cut into calendar years; the
    last row of each year (a row a year) is carried into the next ones, so no single task sorts everything.
    """
    by = by or []
    cols = [c for c in right.columns if c not in by]
    r = right.select(*by, F.col(key).alias("_k"), F.struct(*cols).alias("_r"))
    lr = left.select("*", F.col(key).alias("_k"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_o"))
    both = lr.unionByName(r.withColumn("_o", F.lit(0)), allowMissingColumns=True)
    if by:
        w = Window.partitionBy(*by).orderBy("_k", "_o").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(name, F.last("_r", ignorenulls=True).over(w)).where("_o = 1").drop("_k", "_r", "_o")
    both = both.withColumn("_y", F.year("_k"))
    w = Window.partitionBy("_y").orderBy("_k", "_o").rowsBetween(Window.unboundedPreceding, 0)
    years = r.groupBy(F.year("_k").alias("_y")).agg(F.max_by("_r", "_k").alias("_end"))
    spread = years.select(F.col("_y").alias("_ry"), "_end")
    every = both.where("_o = 1").select("_y").distinct()
    carry = every.join(F.broadcast(spread), F.col("_ry") < F.col("_y"), "left").groupBy("_y").agg(F.max_by("_end", "_ry").alias("_prev"))
    out = both.withColumn("_own", F.last("_r", ignorenulls=True).over(w)).where("_o = 1").join(F.broadcast(carry), "_y", "left")
    return out.withColumn(name, F.coalesce("_own", "_prev")).drop("_k", "_r", "_o", "_y", "_own", "_prev")


def tenor_vol(found: Column, horizon: Column) -> Column:
    """Volatility for a horizon: 9-day up to 9, linear to the 30-day one below 30, 3-month from 30; the 30-day where a tenor is null."""
    v9, v30, v3m = found["iv_9d"], found["iv_30d"], found["iv_3m"]
    between = F.when(v9.isNull() | v30.isNull(), F.coalesce(v30, v9)).otherwise(v9 + (v30 - v9) * (horizon - 9) / 21.0)
    return F.when(horizon <= 9, F.coalesce(v9, v30)).when(horizon < 30, between).otherwise(F.coalesce(v3m, v30))


def implied_vol(frame: DataFrame, iv: DataFrame, most: int = 5) -> DataFrame:
    """iv_vol: daily implied volatility for each row's horizon from the last table row, unless over ``most`` weekdays old."""
    f = as_of(frame, iv)
    fresh = F.when(business_days(F.col("found")["dt"], F.col("dt")) <= most, F.col("found"))
    return f.withColumn("found", fresh).withColumn("iv_vol", tenor_vol(F.col("found"), F.col("horizon"))).drop("found")


def nearest_event(frame: DataFrame, events: DataFrame, reach: int = 20) -> DataFrame:
    """proximity: max(0, 1 - days to the nearest event / reach), by the events before and after each date."""
    after = events.select((-F.datediff("event_dt", F.lit("1970-01-01").cast("date"))).alias("n"), F.col("event_dt"))
    f = as_of(frame, events.select(F.col("event_dt").alias("dt")), name="_before")
    lo = F.datediff("dt", F.col("_before")["dt"])
    f = f.withColumn("_lo", lo).drop("_before")
    dates = frame.select("dt").distinct()
    within = dates.withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(reach)))).withColumn("event_dt", F.expr("date_add(dt, _e)"))
    ahead = within.join(after.select("event_dt").distinct(), "event_dt").groupBy("dt").agg(F.min("_e").alias("_hi"))
    gap = F.least(F.coalesce("_lo", F.lit(10**6)), F.coalesce("_hi", F.lit(10**6)))
    return f.join(ahead, "dt", "left").withColumn("proximity", F.greatest(F.lit(0.0), 1 - gap / float(reach))).drop("_lo", "_hi")


def event_count(frame: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """n_events in [dt, the date ``horizon`` rows on], cut at the ticker's last date.

    Counts of events up to a date are a running sum over the distinct dates of both sides, so the count
    in an interval is a difference of two as-of lookups instead of a range join.
    """
    w = Window.partitionBy("ticker").orderBy("dt")
    end = F.coalesce(F.lead("dt", horizon).over(w), F.max("dt").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    total = running_count(events)
    f = as_of(frame.withColumn("_d", F.col("dt")).withColumn("dt", end), total, name="_hi").withColumn("dt", F.date_sub("_d", 1))
    f = as_of(f, total, name="_lo").withColumn("dt", F.col("_d"))
    n = F.coalesce(F.col("_hi")["seen"], F.lit(0)) - F.coalesce(F.col("_lo")["seen"], F.lit(0))
    return f.withColumn("n_events", n.cast("long")).drop("_d", "_hi", "_lo")


def running_count(events: DataFrame) -> DataFrame:
    """(dt, seen): how many events lie at or before each event date; years are summed apart, so no task sorts all dates."""
    per_day = events.groupBy(F.col("event_dt").alias("dt")).agg(F.count("*").alias("c"))
    per_year = per_day.groupBy(F.year("dt").alias("y")).agg(F.sum("c").alias("c"))
    before = per_year.alias("a").join(F.broadcast(per_year.alias("b")), F.col("b.y") < F.col("a.y"), "left").groupBy("a.y").agg(F.coalesce(F.sum("b.c"), F.lit(0)).alias("past"))
    running = Window.partitionBy("y").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.withColumn("y", F.year("dt")).join(F.broadcast(before), "y").select("dt", (F.sum("c").over(running) + F.col("past")).alias("seen"))


def resolve_by_position(forecasts: DataFrame, panel: DataFrame) -> DataFrame:
    """Forecasts (ticker, dt, horizon) with realized_return between their date and ``horizon`` rows on; unknown dates and open outcomes are left out."""
    at = panel.select("ticker", "dt", F.col("idx"), F.col("price").alias("p0"))
    then = panel.select("ticker", F.col("idx").alias("_to"), F.col("price").alias("p1"), F.col("dt").alias("resolved_dt"))
    f = forecasts.join(at, ["ticker", "dt"]).withColumn("_to", F.col("idx") + F.col("horizon"))
    return f.join(then, ["ticker", "_to"]).withColumn("realized_return", F.col("p1") / F.col("p0") - 1).drop("_to", "p0", "p1")


def resolution_date(panel: DataFrame, horizon: int) -> DataFrame:
    """resolves: the date ``horizon`` rows on, null where the calendar ends."""
    return panel.withColumn("resolves", F.lead("dt", horizon).over(Window.partitionBy("ticker").orderBy("dt")))
