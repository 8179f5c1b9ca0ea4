"""Scans of labelled / unlabelled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators.folds import union_split


def read_frame(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet", sentinel: str | None = None) -> DataFrame:
    """Read one table.  CSV needs an explicit schema (no inference at scale);
    ``sentinel`` becomes NULL at the scan for CSV (``nullValue``)."""
    if fmt == "csv":
        r = spark.read.option("header", True)
        if sentinel is not None:
            r = r.option("nullValue", sentinel)
        if schema is None:
            raise ValueError("CSV scans need an explicit schema")
        df = r.schema(schema).csv(path)
        if sentinel is not None:
            # nullValue matches text only ("-1" but not "-1.0"): fold typed values too
            numeric = [f.name for f in schema.fields
                       if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType,
                                                  T.FloatType, T.DoubleType))]
            df = sentinel_as_null(df, numeric, float(sentinel))
        return df
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.format(fmt).load(path)


def sentinel_as_null(df: DataFrame, cols: Sequence[str], sentinel=-1) -> DataFrame:
    """S3 for typed sources: ``nullif(col, sentinel)``; NaN is folded into NULL too."""
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c in cols:
            e = F.nullif(F.col(c), F.lit(sentinel))
            if types[c] in ("double", "float"):
                e = F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(e)
            out.append(e.alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def read_labelled(train: DataFrame, test: DataFrame, label: str = "target",
                  id_col: str = "id", expect: tuple[int, int] | None = None) -> DataFrame:
    """Train + test as one frame with ``split``; ids stay columns.  ``expect``
    checks both row counts in one aggregate."""
    both = union_split(train, test, label)
    if expect is not None:
        got = both.groupBy("split").count().collect()
        counts = {r["split"]: r["count"] for r in got}
        if (counts.get("train", 0), counts.get("test", 0)) != tuple(expect):
            raise ValueError(f"expected train/test rows {expect}, found {counts}")
    return both
