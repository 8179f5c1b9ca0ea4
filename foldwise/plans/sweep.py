"""Parameter sweeps.

Points in a box are drawn from md5 of (seed, point, parameter): reproducible
and identical in any engine.  Each point is cross-validated on the
existing ``fold`` column; MLlib fits the points of a fold concurrently
(``parallelism``), and one exact-Gini pass scores all folds x points.  The sequential
Gaussian-process optimiser of the reference is not reproduced (see README).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.metrics import gini
from foldwise.session import materialize, released


def _unit(seed: int, point: int, name: str) -> float:
    h = hashlib.md5(f"{seed}:{point}:{name}".encode()).hexdigest()[:8]
    return int(h, 16) / 4294967296.0


def param_grid(box: Mapping[str, tuple], n: int, seed: int = 1024) -> list[dict]:
    """``box``: name -> (lo, hi, kind) with kind 'lin' | 'log' | 'int'."""
    pts = []
    for i in range(n):
        p = {}
        for name, (lo, hi, kind) in box.items():
            u = _unit(seed, i, name)
            if kind == "log":
                p[name] = math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo)))
            elif kind == "int":
                p[name] = lo + u * (hi - lo + 1)
            else:
                p[name] = lo + u * (hi - lo)
        pts.append(p)
    return pts


def param_sanitise(point: Mapping[str, float], int_params: Sequence[str] = (), unit_params: Sequence[str] = (),
                   leaves: tuple[str, str] | None = None) -> dict:
    """Truncate integer parameters, clamp fractions to [0, 1], keep
    ``num_leaves <= 2**max_depth``."""
    out = dict(point)
    for k in int_params:
        if k in out:
            out[k] = int(out[k])
    for k in unit_params:
        if k in out:
            out[k] = max(min(float(out[k]), 1.0), 0.0)
    if leaves and leaves[0] in out and leaves[1] in out:
        out[leaves[0]] = min(int(out[leaves[0]]), 2 ** int(out[leaves[1]]))
    return out


def _stored(df: DataFrame, label: str, fold_col: str, features: Sequence[str]) -> DataFrame:
    """What the fits read, stored once and dealt over all cores: few splits of a narrow table would do all the work."""
    data = df.filter(F.col(fold_col).isNotNull()).select(label, fold_col, *features)
    return materialize(data.repartition(2 * df.sparkSession.sparkContext.defaultParallelism), "sweep")


def _check_folds(data: DataFrame, fold_col: str, k: int) -> None:
    sizes = {r[fold_col]: r["count"] for r in data.groupBy(fold_col).count().collect()}
    beyond = sorted(j for j in sizes if not 0 <= j < k)
    if beyond:
        raise ValueError(f"fold numbers must be in [0, {k}), found {beyond[:5]}")
    for j in range(k):
        if j not in sizes:
            raise ValueError(f"the validation data at fold {j} is empty")
        if len(sizes) == 1:
            raise ValueError(f"the training data at fold {j} is empty")


def _scored(rows: DataFrame, models: Sequence, j: int) -> DataFrame:
    """(label, fold, point, p): the held-out rows of fold ``j`` once per model, all models in one pass."""
    from pyspark.ml.functions import vector_to_array
    kept = rows.columns
    for i, model in enumerate(models):
        rows = model.transform(rows).select(*kept, vector_to_array(F.col("probability"))[1].alias(f"_p{i}"))
        kept = rows.columns
    probs = F.array(*[F.col(f"_p{i}") for i in range(len(models))])
    return rows.select("y", F.lit(j).alias("fold"), F.posexplode(probs).alias("point", "p"))


def param_sweep(df: DataFrame, estimator, points: Sequence[Mapping], features: Sequence[str],
                label: str = "target", fold_col: str = "fold", k: int = 5, parallelism: int = 4) -> DataFrame:
    """Mean CV Gini per point, as a table ``(point, <params>, mean_gini)``.

    The narrow rows are stored once; the Ginis of all folds and points come from one ordered pass.  A fold
    whose held-out rows have one class counts as minus infinity."""
    from pyspark.ml.feature import VectorAssembler
    spark = df.sparkSession
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    est = estimator.setFeaturesCol("features").setLabelCol(label)
    maps = [{est.getParam(name): value for name, value in p.items()} for p in points]
    means = []
    with released(spark):
        data = _stored(df, label, fold_col, features)
        _check_folds(data, fold_col, k)
        scored = None
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(maps)))) as pool:
            for j in range(k if maps else 0):
                train = asm.transform(data.filter(F.col(fold_col) != j)).select(label, "features")
                models = list(pool.map(lambda m, train=train: est.fit(train, m), maps))
                held = asm.transform(data.filter(F.col(fold_col) == j)).select(F.col(label).alias("y"), "features")
                part = _scored(held, models, j)
                scored = part if scored is None else scored.unionByName(part)
        if scored is not None:
            found = {(r["point"], r["fold"]): r["g"] for r in gini(scored, "y", "p", ["point", "fold"], "g").collect()}
            by_fold = [[found.get((i, j)) for j in range(k)] for i in range(len(maps))]
            means = [sum(float("-inf") if g is None else g for g in own) / k for own in by_fold]
    names = list(points[0].keys()) if points else []
    rows = [(i, *[float(p[n]) for n in names], float(m)) for i, (p, m) in enumerate(zip(points, means))]
    schema = "point int, " + ", ".join(f"{n} double" for n in names) + ", mean_gini double"
    return spark.createDataFrame(rows, schema)
