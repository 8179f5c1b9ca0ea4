"""Cluster-distance features.

Feature j of a row is ``exp(-gamma * ||x - c_j||)`` (distance, not squared, as
in the reference; ``squared=True`` gives the usual RBF).  Centers are model
parameters (k x d numbers, e.g. 200 x 64); a pandas UDF computes the distances of an Arrow
batch to all centers as one matrix product, so neither the plan nor the generated
code grows with k, and no join or shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double_array(col: str) -> Column:
    return F.transform(F.col(col), lambda x: x.cast("double"))


def label_centroids(df: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """Mean vector per label: ``(label, pos, value)`` long form, one aggregate."""
    long = df.select(label_col, F.posexplode(as_double_array(vec_col)).alias("pos", "x"))
    return long.groupBy(label_col, "pos").agg(F.avg("x").alias("value"))


def collect_centers(long_centers: DataFrame, key_col: str) -> list[tuple[object, list[float]]]:
    """The centers (one per label, a model parameter) as ``[(key, vector)]`` sorted by key."""
    acc: dict = {}
    for r in long_centers.collect():
        acc.setdefault(r[key_col], {})[r["pos"]] = r["value"]
    return [(k, [v[i] for i in sorted(v)]) for k, v in sorted(acc.items())]


def rbf_features(df: DataFrame, vec_col: str, centers: Sequence[tuple[object, Sequence[float]]],
                 gamma: float = 1.0, prefix: str = "rbf_", squared: bool = False,
                 keep: Sequence[str] | None = None) -> DataFrame:
    """One column per center; a NULL vector has NULL features."""
    matrix = np.array([c for _, c in centers], dtype=float)

    @F.pandas_udf("array<double>")
    def features(vectors: pd.Series) -> pd.Series:
        known = vectors.notna().to_numpy()
        out: list = [None] * len(vectors)
        x = np.array(vectors[known].tolist(), dtype=float)
        if len(x):
            # differences in blocks: exact to the last bits also where |x| is large
            dist = np.empty((len(x), len(matrix)))
            for at in range(0, len(x), 256):
                diff = x[at:at + 256, None, :] - matrix[None, :, :]
                dist[at:at + 256] = np.einsum("ijk,ijk->ij", diff, diff)
            value = np.exp(-gamma * (dist if squared else np.sqrt(dist)))
            for i, row in zip(np.flatnonzero(known), value, strict=True):
                out[i] = row
        return pd.Series(out)

    keep = list(keep) if keep is not None else [c for c in df.columns]
    rows = df.select(*keep, features(as_double_array(vec_col)).alias("_rbf"))
    return rows.select(*keep, *[F.col("_rbf")[i].alias(f"{prefix}{k}") for i, (k, _) in enumerate(centers)])


def kmeans_centers(df: DataFrame, vec_col: str, k: int, seed: int = 1, max_iter: int = 300, starts: int = 1):
    """Fit MLlib k-means on the vectors (the best of ``starts`` by cost) and return its centers
    ``[(j, vector)]``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = df.filter(F.col(vec_col).isNotNull()).select(array_to_vector(as_double_array(vec_col)).alias("features"))
    best = None
    for i in range(starts):
        model = KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="features").fit(data)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return [(j, [float(x) for x in c]) for j, c in enumerate(best.clusterCenters())]
