"""Running sums in a global order without a single-partition window.

Rows are range-partitioned on ``(groups, order)`` into buckets and the bucket
id is stored with a reliable checkpoint, so both uses below see the same
buckets even if a task is re-run.  Bucket totals (at most ``buckets + groups``
rows) get their own running sum and are joined back as offsets, broadcast
when their counted size is under the bound; inside a bucket an ordinary
window finishes the job.  Callers pass
rows that are already aggregated to one row per order key (distinct scores,
distinct values), so a hot key costs one row, not a third of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.joins import join_stats
from foldwise.session import default_buckets, materialize


BUCKET_ROWS = 1_000_000       # rows one task sorts


def running_sums(df: DataFrame, groups: list[str], order: list[str], sums: list[str],
                 buckets: int | None = None, suffix: str = "_before", totals: str | None = None) -> DataFrame:
    """Add ``<c><suffix>`` = sum of ``c`` over rows strictly before this row
    (same ``groups``, ordered by ``order``).  ``order`` must be unique per group.
    With ``totals`` the sum of the first of ``sums`` over the whole group is added too.

    The number of buckets follows the rows (``BUCKET_ROWS`` each, at least the shuffle
    partitions): the frame is stored once, counted, and dealt by range."""
    spark = df.sparkSession
    n = buckets
    if n is None:
        df = materialize(df, "unordered")
        n = max(default_buckets(spark), -(-df.count() // BUCKET_ROWS))
    ranged = materialize(
        df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in groups + order])
          .withColumn("_bkt", F.spark_partition_id()))
    per_bucket = ranged.groupBy(*groups, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    w_off = Window.partitionBy(*groups).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(f"_t_{sums[0]}").over(Window.partitionBy(*groups)).alias(totals)] if totals else []
    offsets = per_bucket.select(*groups, "_bkt",
                                *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}")
                                  for c in sums], *whole)
    w_in = Window.partitionBy(*groups, "_bkt").orderBy(*[F.col(c).asc_nulls_first() for c in order]) \
        .rowsBetween(Window.unboundedPreceding, -1)
    # offsets: at most ``n`` rows without groups (proven), else counted before broadcasting
    n_off = n if not groups else per_bucket.count()
    joined = join_stats(ranged, offsets, groups + ["_bkt"], "inner", n_stats=n_off)
    out = joined.select(*df.columns, *([totals] if totals else []),
                        *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w_in), F.lit(0))).alias(f"{c}{suffix}")
                          for c in sums])
    return out


def dense_codes(distinct: DataFrame, groups: list[str], order: list[str], out: str = "code",
                buckets: int | None = None) -> DataFrame:
    """0-based dense rank of each distinct ``order`` tuple within ``groups``."""
    d = distinct.withColumn("_one", F.lit(1).cast("bigint"))
    r = running_sums(d, groups, order, ["_one"], buckets)
    return r.select(*groups, *order, F.col("_one_before").alias(out))
