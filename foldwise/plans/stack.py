"""Stacking over stored predictions.

Level L+1 reads the long prediction table of level L, pivots it to one column
per model (names listed, so no extra distinct job), joins labels and runs the
same out-of-fold plan with the *same* fold assignment as level L.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.folds import kfold
from foldwise.plans.models import ModelSpec
from foldwise.plans.oof import oof_train
from foldwise.session import materialize
from foldwise.sources.predictions import stack_matrix


def stack_frame(preds: DataFrame, labels: DataFrame, models: Sequence[str], k: int = 5, seed: int = 1024,
                id_col: str = "id", label: str = "target") -> DataFrame:
    """``(id, split, target, fold, model_1..model_n)``; a model missing for an id is an error."""
    train = stack_matrix(preds, list(models), "train").withColumn("split", F.lit("train"))
    test = stack_matrix(preds, list(models), "test").withColumn("split", F.lit("test"))
    wide = train.unionByName(test)
    frame = wide.join(labels.select(id_col, label), id_col, "left")
    frame = frame.withColumn(label, F.when(F.col("split") == "train", F.col(label)))
    return kfold(frame, k, seed)


def check_complete(frame: DataFrame, models: Sequence[str]) -> None:
    bad = not frame.filter(" OR ".join(f"`{m}` IS NULL" for m in models)).isEmpty()
    if bad:
        raise ValueError("prediction table is missing a model for some id (file pairs out of step?)")


def stack_level(preds: DataFrame, labels: DataFrame, models: Sequence[str], spec: ModelSpec, k: int = 5,
                seed: int = 1024, bags: int = 1, parallelism: int = 2, check: bool = True) -> DataFrame:
    """One stacking level: returns the next level's long prediction table, stored, as the
    next level reads it more than once."""
    frame = materialize(stack_frame(preds, labels, models, k, seed), "stack-frame")
    if check:
        check_complete(frame, models)
    return materialize(oof_train(frame, spec, list(models), k=k, bags=bags, seed=seed, parallelism=parallelism),
                       "stack-level")
