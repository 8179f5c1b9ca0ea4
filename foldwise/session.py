"""Session construction, checkpoint location and materialisation helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Statistics tables with at most this many rows are broadcast explicitly; larger
# ones are joined with a shuffle (and AQE may still demote them at run time).
BROADCAST_MAX_ROWS_CONF = "foldwise.broadcast.maxRows"
BROADCAST_MAX_ROWS_DEFAULT = 1_000_000
# ... and, by schema, at most this many bytes (rows x estimated row width).
BROADCAST_MAX_BYTES_CONF = "foldwise.broadcast.maxBytes"
BROADCAST_MAX_BYTES_DEFAULT = 64 << 20


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "foldwise", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names shared storage and is used as is.  Only when
    it is unset on a local master (tests) a private folder is created for the run; on any
    other master a folder of the driver would be missing on the executors, so that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="foldwise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/foldwise-tables/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing the frame once as Parquet below the reliable
    checkpoint folder and reading it back.

    Unlike an eager ``checkpoint()`` of an unpersisted plan (computed once for
    the action and again for the checkpoint files) this runs the plan once;
    the read-back carries file-size statistics for join planning and survives
    executor loss (it never depends on executor-local blocks).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    for paths in getattr(_SCOPES, "open", []):
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


_SCOPES = threading.local()


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def released(spark: SparkSession):
    """Delete on exit whatever ``materialize`` wrote inside (in this thread): for
    results that have left Spark, such as a score read by the driver."""
    stack = _SCOPES.__dict__.setdefault("open", [])
    paths: list[str] = []
    stack.append(paths)
    try:
        yield
    finally:
        stack.remove(paths)
        for path in paths:
            delete_path(spark, path)


def broadcast_max_rows(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get(BROADCAST_MAX_ROWS_CONF))
    except Exception:  # noqa: BLE001 - unset key
        return BROADCAST_MAX_ROWS_DEFAULT


def broadcast_max_bytes(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get(BROADCAST_MAX_BYTES_CONF))
    except Exception:  # noqa: BLE001 - unset key
        return BROADCAST_MAX_BYTES_DEFAULT


def default_buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
