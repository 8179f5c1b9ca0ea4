"""External feature tables and persisted features.

The reference matches precomputed feature files to rows by position; here
every feature table is keyed by ``id`` and joined with an equi-join.  Both sides
must be unique in the key and every row must find its features: one aggregate over
the joined keys checks all three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import scratch_path


def check_one_to_one(rows: DataFrame, feats: DataFrame, key: str, complete: bool = True) -> None:
    """Raise when a key repeats on either side or (``complete``) a row has no features."""
    sides = rows.select(key, F.lit(1).alias("_r"), F.lit(0).alias("_f")).unionByName(
        feats.select(key, F.lit(0).alias("_r"), F.lit(1).alias("_f")))
    per = sides.groupBy(key).agg(F.sum("_r").alias("r"), F.sum("_f").alias("f"))
    got = per.agg(F.max("r").alias("r"), F.max("f").alias("f"),
                  F.sum(((F.col("r") > 0) & (F.col("f") == 0)).cast("bigint")).alias("bare")).first()
    if (got["r"] or 0) > 1:
        raise ValueError(f"rows: key {key!r} is not unique")
    if (got["f"] or 0) > 1:
        raise ValueError(f"feature table: key {key!r} is not unique")
    if complete and got["bare"]:
        raise ValueError(f"feature table: {got['bare']} rows have no entry for their {key!r}")


def join_feature_table(rows: DataFrame, feats: DataFrame, key: str = "id", check: bool = True,
                       how: str = "left") -> DataFrame:
    """Attach a feature table by key (1:1).  No row is lost: the join is a left
    join, and with ``check`` a row without features raises (pass ``check=False`` to
    get NULL features instead)."""
    if check:
        check_one_to_one(rows, feats, key)
    return rows.join(feats, key, how)


def replace_cats_with_encoding(rows: DataFrame, encoding: DataFrame, drop_prefix: str = "calc_",
                               cat_marker: str = "_cat", key: str = "id") -> DataFrame:
    """Drop the noise group and the categorical columns, attach an external
    encoding table instead."""
    keep = [c for c in rows.columns if not c.startswith(drop_prefix) and cat_marker not in c]
    return join_feature_table(rows.select(*keep), encoding, key)


def persist_features(df: DataFrame, path: str | None = None, partition_by: Sequence[str] = ("split",),
                     mode: str = "errorifexists") -> str:
    """Write a feature table partitioned by ``split`` (reliable storage under
    the checkpoint location by default); returns the path."""
    path = path or scratch_path(df.sparkSession, "features")
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def read_features(spark, path: str, split: str | None = None) -> DataFrame:
    """S7 read side: the partition filter prunes folders at the scan."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split else df
