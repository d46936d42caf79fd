"""Live operation on Structured Streaming: delayed-label resolution, idempotent publication, windowed counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESOLVED = "ticker string, dt date, horizon int, resolved_dt date, realized_return double"


def resolve_stream(prices: DataFrame, horizon: int) -> DataFrame:
    """Each day's price is a forecast that resolves ``horizon`` days of its ticker later.

    State per ticker is the last ``horizon`` prices, so it is bounded; open forecasts never expire. Within a
    batch rows are taken in order of their day, and older ones than the newest seen are dropped, as the
    source delivers a ticker's days in order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("dt")
        out = []
        for dt, price in zip(rows["dt"], rows["price"]):
            day = str(dt)[:10]
            if held and day <= held[-1][0]:
                continue
            held.append((day, float(price)))
            if len(held) > horizon:
                was, p0 = held.pop(0)
                out.append((key[0], pd.Timestamp(was).date(), horizon, pd.Timestamp(day).date(), float(price) / p0 - 1))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["ticker", "dt", "horizon", "resolved_dt", "realized_return"])

    return prices.groupBy("ticker").applyInPandasWithState(run, RESOLVED, "held string", "append", GroupStateTimeout.NoTimeout)


def publish_once(forecasts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Forecasts without repeated ids within the watermark."""
    f = forecasts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return f.dropDuplicatesWithinWatermark(["forecast_id"])


def tumbling(events: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Count and sum of value by event type and window of event time."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Events of a user no more than ``gap`` apart, as sessions."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is available and stop; sink and progress are in the given folders, so a rerun continues."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
