"""Joining fitted statistics back to rows with a checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.session import broadcast_max_bytes, broadcast_max_rows

ARRAY_ITEMS = 8               # assumed items of an array column


def row_bytes(schema) -> int:
    """Estimated bytes of a row (or value): fixed widths, 32 for strings, ``ARRAY_ITEMS`` items."""
    if isinstance(schema, T.StructType):
        return 8 + sum(row_bytes(f.dataType) for f in schema.fields)
    if isinstance(schema, T.ArrayType):
        return 16 + ARRAY_ITEMS * row_bytes(schema.elementType)
    return 32 if isinstance(schema, (T.StringType, T.BinaryType)) else 8


def join_stats(rows: DataFrame, stats: DataFrame, on, how: str = "left",
               n_stats: int | None = None, width: int | None = None) -> DataFrame:
    """Join a statistics table to the rows.

    ``n_stats`` is the (already known) row count of ``stats``; below the
    configured bounds on rows and on bytes (rows x ``width``, estimated from the
    schema when not given) the side is broadcast, otherwise it is left to a
    shuffle join (AQE re-plans at run time and splits skewed partitions).
    """
    spark = rows.sparkSession
    if n_stats is not None and n_stats <= broadcast_max_rows(spark) \
            and n_stats * (width or row_bytes(stats.schema)) <= broadcast_max_bytes(spark):
        stats = F.broadcast(stats)
    return rows.join(stats, on=on, how=how)
