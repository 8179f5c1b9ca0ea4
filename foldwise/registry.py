"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` plus DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def round_half_away(x, digits: int = 6):
    """``round(x * 10^d) / 10^d`` with C ``round`` (half away from zero) on the
    binary product, which is how SQL engines such as DuckDB round doubles.

    ``F.round(x, d)`` instead rounds the decimal form of ``x`` (HALF_UP through
    BigDecimal): values with exactly d+1 decimals round apart, and it is slow.
    Here ``v - rint(v)`` is exact, so it is 0.5 only at a tie, which moves away
    from zero; from 2^52 on ``v`` is an integer and stays."""
    m = float(10 ** digits)
    v = x * F.lit(m)
    r = F.rint(v)
    return F.when(F.abs(v - r) == 0.5, v + F.signum(v) * 0.5).otherwise(r) / F.lit(m)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation rounding of every double column (see ``round_half_away``)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_half_away(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
