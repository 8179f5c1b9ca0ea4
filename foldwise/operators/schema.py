"""Projections, filters and schema operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.session import materialize


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """P1"""
    return df.drop(*names)


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """P2"""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """Listed features in the given order (after the key columns)."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"unknown features {missing}")
    return df.select(*keep, *features)


def reorder(df: DataFrame, id_col: str = "id", label: str = "target") -> DataFrame:
    """P5: ``id, features..., target`` normal form."""
    mid = [c for c in df.columns if c not in (id_col, label)]
    return df.select(id_col, *mid, label)


FLOAT_MAX = 3.4028234663852886e38

_INT_TYPES = [(T.ByteType(), -128, 127), (T.ShortType(), -32768, 32767),
              (T.IntegerType(), -2**31, 2**31 - 1)]


def narrow_types(df: DataFrame, cols: Sequence[str] | None = None, floats: bool = True) -> DataFrame:
    """Cast integer columns to the narrowest type their min/max fit (one
    aggregate pass for all columns, then one projection) and doubles to float.
    Never narrows a value out of range (unlike a blind int8 cast): a double column with a
    finite value beyond the float range stays double."""
    types = dict(df.dtypes)
    cols = list(cols) if cols is not None else list(df.columns)
    ints = [c for c in cols if types[c] in ("smallint", "int", "bigint")]
    dbls = [c for c in cols if types[c] == "double"] if floats else []
    casts: dict[str, T.DataType] = {}
    if ints or dbls:
        finite = lambda c: F.when(F.abs(c) < float("inf"), F.abs(c))
        row = df.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(ints)],
                     *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(ints)],
                     *[F.max(finite(F.col(c))).alias(f"abs_{i}") for i, c in enumerate(dbls)]).collect()[0]
        for i, c in enumerate(ints):
            lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
            if lo is None:
                continue
            for t, tlo, thi in _INT_TYPES:
                if tlo <= lo and hi <= thi:
                    casts[c] = t
                    break
    for i, c in enumerate(dbls):
        if row[f"abs_{i}"] is None or row[f"abs_{i}"] <= FLOAT_MAX:
            casts[c] = T.FloatType()
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


def replace_value(df: DataFrame, col: str, old, new) -> DataFrame:
    """P10"""
    return df.withColumn(col, F.when(F.col(col) == F.lit(old), F.lit(new)).otherwise(F.col(col)))


def add_placeholder(df: DataFrame, name: str = "target", dtype: str = "int") -> DataFrame:
    """NULL placeholder column (never 0)."""
    return df.withColumn(name, F.lit(None).cast(dtype))


def compose(df: DataFrame, steps: Sequence[tuple[Callable, dict]]) -> DataFrame:
    """Apply ``(fn, kwargs)`` steps in order (``DataFrame.transform`` chain)."""
    for fn, kw in steps:
        df = df.transform(fn, **kw)
    return df


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    """Fail unless the frame has exactly ``n`` rows.  The frame is stored and counted from
    the stored files, so nothing is computed twice; returns the stored frame.  (An
    ``Observation`` would count in the same action, but a session that has one can no
    longer serialise MLlib models in Spark 4.1.)"""
    stored = materialize(df, "expected")
    got = stored.count()
    if got != n:
        raise ValueError(f"expected {n} rows, found {got}")
    return stored
