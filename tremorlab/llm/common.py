"""Shared-folder tables and small helpers for the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of the filter that keeps rows which nothing needs from being shuffled: 4 MB when broadcast, whatever the data.
FILTER_BITS = 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a temporary one where that is unset, elsewhere an error."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = getattr(spark, "_tremor_shared", None)
        if named is None:
            named = "file://" + tempfile.mkdtemp(prefix="tremorlab-")
            spark._tremor_shared = named
    return named.rstrip("/")


class Scratch:
    """Tables of one computation, deleted together at its end or one by one before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written to the shared folder and read back, until the scratch ends."""
        out = materialize(df, label)
        self.paths.append(out._tremor_path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no result still to be computed reads."""
        for path in [t._tremor_path for t in tables]:
            if path in self.paths:
                self.paths.remove(path)
                _delete(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = _path(spark, path)
    fs.delete(hadoop, True)
    fs.cancelDeleteOnExit(hadoop)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage (a lost executor costs no recomputation of what came before) and lets later
    steps read single columns. Shuffle files of the write go at its end, the table when a ``Scratch`` drops it or the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, was)
    fs, hadoop = _path(spark, path)
    fs.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._tremor_path = path
    return out


def flag_by_bitmap(rows: DataFrame, needed: DataFrame, col: str, flag: str) -> DataFrame:
    """``rows`` with a column that is false only where the long ``col`` is not in ``needed``, by a bitmap of fixed size that is broadcast."""
    at = F.pmod(F.col(col), F.lit(FILTER_BITS))
    bits = needed.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    r = rows.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "bucket", "left")
    place = f"bitmap_bit_position(pmod({col}, {FILTER_BITS}L))"
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast({place} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr(f"(shiftright(byte, cast({place} % 8 as int)) & 1) = 1"), F.lit(False))
    return r.withColumn("byte", byte).withColumn(flag, hit).select(*rows.columns, flag)


def keep_only(rows: DataFrame, needed: DataFrame, col: str) -> DataFrame:
    """``rows`` whose long ``col`` is in ``needed``: first by the bitmap, then exactly."""
    return flag_by_bitmap(rows, needed, col, "hit").where("hit").drop("hit").join(needed.select(col), col, "left_semi")


def text_or_empty(col: str = "text") -> F.Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def fold_of(id_col: str, folds: int) -> F.Column:
    """crc32 of the id written as text, modulo ``folds``; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def hash_share(col: str) -> F.Column:
    """A number from 0 to 1 that a column's value is hashed to, for repeatable samples."""
    return F.pmod(F.xxhash64(F.lit(17), F.col(col)), F.lit(1 << 30)) / float(1 << 30)


def chunks(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Consecutive runs of whole texts of about ``chars`` characters."""
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t)
        if size >= chars:
            yield now
            now, size = [], 0
    if now:
        yield now


def map_lists(df: DataFrame, run: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: T.StructType, rows: int | None = None) -> DataFrame:
    """mapInArrow over batches, cut after ``rows`` rows, as dicts of Python lists; unlike pandas columns these keep large ids exact beside nulls."""
    kinds = to_arrow_schema(schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, rows) for b in it for at in range(0, b.num_rows, rows or b.num_rows or 1))
        for out in run({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in parts):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(batches, schema)


def typed(docs: DataFrame, id_col: str, **kinds: T.DataType) -> T.StructType:
    """A schema of doc_id, typed as ``id_col``, and further columns."""
    return T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(n, k) for n, k in kinds.items()])
