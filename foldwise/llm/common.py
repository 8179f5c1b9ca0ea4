"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.session import default_buckets, delete_path, scratch_path


BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts reach the Python workers in batches of at most ``BATCH_BYTES``, so that a
    worker's memory follows the batch and not the length of the texts of 10,000 rows.  A session
    that already asks for smaller batches keeps its setting."""
    now = spark.conf.get(BATCH_CONF, "64m").lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    size = int(now.rstrip("kmg") or 0) * unit
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's own setting comes back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside are deleted when each ends, not when the driver happens to
    collect garbage: a written table needs them no more."""
    with _setting(spark, CLEAN_CONF, "true"):
        yield


COLUMNS_CONF = "spark.sql.parquet.columnarReaderBatchSize"
ROWS_AT_ONCE = 64


@contextmanager
def few_rows_at_once(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside read Parquet by ``ROWS_AT_ONCE`` rows at most: Spark's reader otherwise holds 4,096 rows in
    memory at once, of 128 KB each where they are stored blocks."""
    with _setting(spark, COLUMNS_CONF, str(min(int(spark.conf.get(COLUMNS_CONF, "4096")), ROWS_AT_ONCE))):
        yield


class Scratch:
    """Intermediate tables of one operator call, written as Parquet below
    ``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor
    costs re-run tasks, never data.  ``drop`` and ``keep`` delete tables as soon as nothing
    lazy reads them any more.  A ``tidy`` one also deletes the shuffle files of every table it has
    written, and compresses its tables harder.  Tables are in row groups of ``row_group`` bytes, if given: writers and readers
    hold one at a time."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False, row_group: int | None = None):
        self.spark, self.tidy, self.row_group = spark, tidy, row_group
        self.base = scratch_path(spark, name)
        small_batches(spark)

    def put(self, df: DataFrame, key: str, by: str | None = None) -> DataFrame:
        """The table, written; with ``by`` in a folder ``key/by=value`` per value, which ``drop`` can delete alone."""
        path = f"{self.base}/{key}"
        write = df.write.mode("overwrite")
        if by:
            write = write.partitionBy(by)
        if self.row_group:
            write = write.option("parquet.block.size", self.row_group)
        if self.tidy:
            with shuffles_deleted(self.spark):
                write.option("compression", "zstd").parquet(path)
        else:
            write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keys: str) -> None:
        for key in keys:
            delete_path(self.spark, f"{self.base}/{key}")

    def keep(self, *keys: str) -> None:
        """Delete all tables but those that the (lazy) result still reads."""
        sc = self.spark.sparkContext
        base = sc._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = base.getFileSystem(sc._jsc.hadoopConfiguration())
        if fs.exists(base):
            for entry in fs.listStatus(base):
                if entry.getPath().getName() not in keys:
                    fs.delete(entry.getPath(), True)


def partitions(spark: SparkSession) -> int:
    return default_buckets(spark)


def text_key(text: Column) -> list[Column]:
    """128-bit key of a text as two longs (``k1``, ``k2``); null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
