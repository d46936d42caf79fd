"""Shared-folder paths for state, checkpoints and stream sinks."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; in local mode a temporary one where that is unset, elsewhere an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tremorlab-")
    return f"{named.rstrip('/')}/work/{label}-{uuid.uuid4().hex}"


def modified(spark: SparkSession, path: str) -> float | None:
    """Seconds since the path was last written, null where it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return time.time() - fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else None


def cached(spark: SparkSession, path: str, make, max_age: float) -> DataFrame:
    """The Parquet table at ``path``, written anew by ``make()`` where it is missing or older than ``max_age`` seconds."""
    age = modified(spark, path)
    if age is None or age > max_age:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_state(spark: SparkSession, states: dict[tuple[str, int], dict], path: str) -> None:
    """Model states by (ticker, horizon) as rows of JSON."""
    rows = [(t, h, json.dumps(s)) for (t, h), s in states.items()]
    spark.createDataFrame(rows, "ticker string, horizon int, state string").write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> dict[tuple[str, int], dict]:
    """What save_state wrote."""
    return {(r["ticker"], r["horizon"]): json.loads(r["state"]) for r in spark.read.parquet(path).collect()}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and SHA-256 of each file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))
