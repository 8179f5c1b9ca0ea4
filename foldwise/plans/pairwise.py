"""Pairwise ranking gradients without a list of pairs.

The loss of a pair of a positive row i and a negative row j is ``log(1 + exp(s_j - s_i))``, weighted
``w_i w_j``, over all such pairs.  A row's gradient depends only on its class, its score and how much
weight the other class has at every score.  So rows are first summed to (score bucket, class), at most
``BUCKETS`` of them per group, and the pair sums are taken between buckets: a job costs one pass over
the rows, whatever the number of pairs.

A bucket stands for the middle of the least and greatest score in it.  Buckets that hold a single
score (ties, and every score while there are few) are exact; otherwise a score is off by at most half
of its bucket's spread, itself at most 1 / ``BUCKETS`` of the range.  Rows of one bucket make a tie.

Pairs are weighted by rows / (positives x negatives) on top (all weighted): what one pair drawn per
row would give in expectation, so penalties keep the meaning they have for the logistic loss.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.joins import join_stats

BUCKETS = 2048
LEAST_HESSIAN = 1e-16


def bucket_of(score: np.ndarray, low: float, high: float) -> np.ndarray:
    if not high > low:
        return np.zeros(len(score), np.int64)
    return np.clip(np.floor((score - low) / (high - low) * BUCKETS), 0, BUCKETS - 1).astype(np.int64)


def pair_sums(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """(4, buckets): gradient and hessian of a positive row of weight 1, then of a negative one.

    ``pos`` and ``neg`` are the weights of the two classes at each score.  With one class there are no pairs."""
    out = np.zeros((4, len(score)))
    out[1::2] = LEAST_HESSIAN
    p, n = pos.sum(), neg.sum()
    if not (p > 0 and n > 0):
        return out
    norm = (p + n) / (p * n)
    for at in range(0, len(score), 256):
        own = slice(at, at + 256)
        with np.errstate(over="ignore"):
            above = 1.0 / (1.0 + np.exp(score[own, None] - score[None, :]))      # of the other score against the own
        curve = above * (1.0 - above)
        out[0, own], out[1, own] = -(above @ neg) * norm, (curve @ neg) * norm
        out[2, own], out[3, own] = ((1.0 - above) @ pos) * norm, (curve @ pos) * norm
    out[1::2] = np.maximum(out[1::2], LEAST_HESSIAN)
    return out


def tables(sums: pd.DataFrame) -> np.ndarray:
    """(4, ``BUCKETS``) from the rows (bucket, pos, neg, low, high) of one group; empty buckets stay 0."""
    out = np.zeros((4, BUCKETS))
    sums = sums.sort_values("bucket")
    middle = sums["low"].to_numpy() + (sums["high"].to_numpy() - sums["low"].to_numpy()) / 2.0
    out[:, sums["bucket"].to_numpy()] = pair_sums(middle, sums["pos"].to_numpy(float), sums["neg"].to_numpy(float))
    return out


def pair_gradients(df: DataFrame, label: str = "target", score: str = "pred", by: Sequence[str] = (),
                   weight: Column | None = None) -> DataFrame:
    """``df`` with ``g`` and ``h``: gradient and hessian of the pairwise loss at ``score``, inside each group of ``by``.

    Rows without label or score make no pair and get NULL.  The driver holds groups x ``BUCKETS`` rows."""
    spark, by = df.sparkSession, list(by)
    use = F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    rows = df.withColumn("_s", F.when(use, F.col(score).cast("double"))).withColumn("_w", F.lit(1.0) if weight is None else weight)
    span = rows.agg(F.min("_s"), F.max("_s")).first()
    low, high = (0.0, 0.0) if span[0] is None else span
    place = F.floor((F.col("_s") - F.lit(low)) / F.lit((high - low) or 1.0) * F.lit(float(BUCKETS)))
    rows = rows.withColumn("_b", F.when(F.col("_s").isNotNull(), F.least(F.greatest(place, F.lit(0)), F.lit(BUCKETS - 1))).cast("int"))
    positive = F.col(label) == 1
    sums = (rows.filter("_b IS NOT NULL").groupBy(*by, "_b")
            .agg(F.sum(F.when(positive, F.col("_w")).otherwise(0.0)).alias("pos"), F.sum(F.when(positive, 0.0).otherwise(F.col("_w"))).alias("neg"),
                 F.min("_s").alias("low"), F.max("_s").alias("high")).withColumnRenamed("_b", "bucket"))
    local = sums.toPandas()
    keys = [f"_k{i}" for i in range(len(by))]
    parts = []
    for _, own in local.groupby(by, dropna=False) if by else [((), local)]:
        found = tables(own)[:, own["bucket"].to_numpy()]
        parts.append(pd.DataFrame({"_b": own["bucket"].to_numpy(), **dict(zip(("gp", "hp", "gn", "hn"), found)),
                                   **{k: own[c].to_numpy() for k, c in zip(keys, by)}}))
    kinds = ", ".join(["_b int", "gp double", "hp double", "gn double", "hn double",
                       *[f"{k} {df.schema[c].dataType.simpleString()}" for k, c in zip(keys, by)]])
    table = pd.concat(parts) if len(local) else None
    pairs = spark.createDataFrame([] if table is None else table, kinds)
    same = [F.col("_b") == F.col("_pb"), *[F.col(c).eqNullSafe(F.col(k)) for k, c in zip(keys, by)]]
    out = join_stats(rows, pairs.withColumnRenamed("_b", "_pb"), same, "left", len(local))
    return out.select(*df.columns, F.when(positive, F.col("gp") * F.col("_w")).otherwise(F.col("gn") * F.col("_w")).alias("g"),
                      F.when(positive, F.col("hp") * F.col("_w")).otherwise(F.col("hn") * F.col("_w")).alias("h"))
