"""Flagship plan: OOF target encoding of the planted fixture, Gini per (column, fold)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators import metrics as me
from foldwise.operators import target as te
from foldwise.sources import fixtures as fx


def encoding_gini_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.planted(spark, sf_dir)
    cats = fx.CAT_FEATURES
    enc = te.target_encode_oof(df, cats, min_samples_leaf=200, smoothing=10)
    long = enc.select("id", "fold", "target", *[c + "_avg" for c in cats]) \
        .unpivot(["id", "fold", "target"], [c + "_avg" for c in cats], "feature", "pred")
    return me.gini(long, "target", "pred", ["feature", "fold"])
