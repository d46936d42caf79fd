"""Append-only forecast and resolution ledgers, and live scores over their join."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORECAST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("forecast_id", "ticker", "model_version", "config_hash", "data_hash")]
    + [T.StructField("dt", T.DateType()), T.StructField("horizon", T.IntegerType()), T.StructField("expected_dt", T.DateType())]
    + [T.StructField(n, T.DoubleType()) for n in ("price", "threshold", "sigma", "p_raw", "p_cal")]
)
RESOLUTION = T.StructType([T.StructField("forecast_id", T.StringType()), T.StructField("resolved_dt", T.DateType()), T.StructField("realized_return", T.DoubleType()), T.StructField("y", T.DoubleType())])


def load(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON-lines ledger; a typed empty table where there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def first_of(frame: DataFrame, key: str = "forecast_id", order: list[str] | None = None) -> DataFrame:
    """The first row of each id."""
    w = Window.partitionBy(key).orderBy(*(order or [c for c in frame.columns if c != key]))
    return frame.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def append(spark: SparkSession, rows: DataFrame, path: str, schema: T.StructType) -> int:
    """Append rows whose id is not in the ledger yet; gives their number. Nothing that is there is changed."""
    known = load(spark, path, schema).select("forecast_id")
    new = first_of(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])).join(known, "forecast_id", "left_anti").persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").json(path)
        return n
    finally:
        new.unpersist()


def joined(forecasts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Every forecast with its first resolution, if any."""
    return forecasts.join(first_of(resolutions), "forecast_id", "left")


def pending(forecasts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Forecasts without a resolution."""
    return forecasts.join(resolutions.select("forecast_id"), "forecast_id", "left_anti")


def from_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forecasts and resolutions from an event table: each signup and the same user's first later purchase.

    The next purchase is found by one backward window over each user's events instead of a range join.
    """
    e = events.where(F.col("event_type").isin("signup", "purchase"))
    later = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    buy = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id", "value"))
    e = e.withColumn("_b", F.last(buy, ignorenulls=True).over(later)).where("event_type = 'signup'")
    e = e.withColumn("forecast_id", F.substring(F.sha2(F.col("event_id").cast("string").cast("binary"), 256), 1, 16))
    r = e.where(F.col("_b").isNotNull() & (F.col("_b.ts") > F.col("ts"))).select("forecast_id", F.col("_b.event_id").alias("resolved_by"), F.col("_b.value").alias("outcome"))
    return e.drop("_b"), r


def live_metrics(live: DataFrame, by: list[str], least: int = 30) -> DataFrame:
    """Counts and Brier score for each single column of ``by`` and overall, in one pass; small marks groups under ``least`` outcomes."""
    sets = [[F.col(c)] for c in by] + [[]]
    g = live.groupingSets(sets, *[F.col(c) for c in by])
    return g.agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("n_resolved"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), (F.count("y") < least).alias("small"))


def anchor(spark: SparkSession, paths: dict[str, str]) -> dict:
    """Digest and line count of each ledger and a combined digest; digests do not depend on file boundaries."""
    out = {}
    for name, path in sorted(paths.items()):
        lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
        n, s = lines.agg(F.count("*"), F.sum(F.conv(F.substring(F.sha2(F.col("value").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)"))).first()
        out[name] = {"lines": n, "digest": str(s or 0)}
    stamp = datetime.now(UTC).isoformat(timespec="seconds")
    return {"at": stamp, "files": out, "combined": json.dumps(out, sort_keys=True)}


def verify_anchor(spark: SparkSession, saved: dict, paths: dict[str, str]) -> bool:
    """Whether the ledgers are as they were."""
    return anchor(spark, paths)["combined"] == saved["combined"]
