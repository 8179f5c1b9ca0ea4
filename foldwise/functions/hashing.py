"""Deterministic hash buckets: the basis of splits, folds and parameter points.

``md5(seed:id)`` truncated to 8 hex digits is a stable, order-free draw that
needs no sort and no shuffle, and DuckDB computes the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_u32(seed, col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    key = F.concat(F.lit(f"{seed}:"), c.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def hash_mod(seed, col: str | Column, k: int) -> Column:
    return F.pmod(hash_u32(seed, col), F.lit(k))


def hash_unit(seed, col: str | Column) -> Column:
    """Uniform draw in [0, 1) from the 32-bit hash."""
    return hash_u32(seed, col) / F.lit(4294967296.0)


def duck_hash_u32(seed, col: str) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 8)) AS BIGINT)"


def duck_hash_mod(seed, col: str, k: int) -> str:
    return f"({duck_hash_u32(seed, col)} % {k})"
