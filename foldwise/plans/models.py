"""Learners, parameter mapping and the named model registry.

Reference parameters are translated to MLlib estimators.  A name that no learner
knows raises; a name without an MLlib counterpart raises too, unless the caller accepts
dropping it (``dropped_params`` lists what a spec loses, for reports).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# No MLlib counterpart, or a counterpart in other units (``gamma`` is a loss
# reduction in hessian units; MLlib's ``minInfoGain`` is an impurity gain, and
# 0.59 of it blocks every split).
UNSUPPORTED = {"reg_alpha", "reg_lambda", "num_leaves", "subsample_freq", "colsample_bylevel",
               "n_jobs", "silent", "objective", "booster", "nthread", "max_bin_by_feature", "gamma"}
# Translated names by learner; ``seed`` and ``scale_pos_weight`` are read by the training plan.
SUPPORTED = {
    "lr": {"C", "penalty", "max_iter"},
    "linear": {"alpha", "lambda", "max_iter"},
    "gbt": {"learning_rate", "eta", "n_estimators", "max_depth", "subsample", "colsample_bytree", "min_child_weight",
            "min_child_samples", "max_bin"},
    "rf": {"n_estimators", "max_depth", "min_samples_leaf"},
    "mlp": {"hidden", "n_features", "max_iter", "learning_rate"},
}
FOREST = "forest"        # regularised forest with corrected leaf weights (plans/corrective.py)
BOOSTED = "newton"      # second-order trees (plans/boost.py): every parameter of the native libraries counts
COMMON = {"seed", "scale_pos_weight"}


@dataclass
class ModelSpec:
    """``bag``, ``split`` and ``fold`` are the defaults of the training plan for this model."""
    name: str
    mdl_type: str                    # lr | linear | gbt | rf | mlp | newton | forest
    param: dict = field(default_factory=dict)
    bag: int = 1
    split: int = 1
    fold: int = 5
    note: str = ""


def class_weights(df: DataFrame, label: str = "target", pos_weight: float = 1.0, out: str = "weight") -> DataFrame:
    """M6: ``scale_pos_weight`` as an MLlib ``weightCol``."""
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))


def dropped_params(spec: ModelSpec) -> list[str]:
    """Names of the spec that have no MLlib counterpart."""
    if spec.mdl_type in (BOOSTED, FOREST):
        return []
    return sorted(k for k in spec.param if k in UNSUPPORTED)


def _check(spec: ModelSpec, allow_drop: bool) -> dict:
    if spec.mdl_type not in SUPPORTED:
        raise ValueError(f"unknown model type {spec.mdl_type!r}")
    unknown = sorted(k for k in spec.param if k not in UNSUPPORTED | COMMON | SUPPORTED[spec.mdl_type])
    if unknown:
        raise ValueError(f"unknown parameters for {spec.mdl_type!r}: {unknown}")
    if dropped_params(spec) and not allow_drop:
        raise ValueError(f"parameters without an MLlib counterpart: {dropped_params(spec)}")
    return {k: v for k, v in spec.param.items() if k not in UNSUPPORTED | COMMON}


def linear_penalties(spec: ModelSpec, allow_drop: bool = False) -> dict:
    """Penalties on raw coefficients and the summed loss: C of scikit-learn, alpha and lambda of the linear booster."""
    p = _check(spec, allow_drop)
    rounds = {"max_iter": int(p["max_iter"])} if "max_iter" in p else {}
    if spec.mdl_type == "linear":
        return {"l1": float(p.get("alpha", 0.0)), "l2": float(p.get("lambda", 1.0)), **rounds}
    strength = 1.0 / float(p.get("C", 1.0))
    return {"l1" if p.get("penalty", "l2") == "l1" else "l2": strength,
            "l2" if p.get("penalty", "l2") == "l1" else "l1": 0.0, **rounds}


def build_estimator(spec: ModelSpec, n_train: int, features_col: str = "features", label: str = "target",
                    weight_col: str | None = None, seed: int = 1024, allow_drop: bool = False):
    """The MLlib estimator for one fold model."""
    from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                           MultilayerPerceptronClassifier, RandomForestClassifier)
    p = _check(spec, allow_drop)
    common = dict(featuresCol=features_col, labelCol=label)
    weighted = dict(weightCol=weight_col) if weight_col else {}
    if spec.mdl_type == "lr":
        c = float(p.get("C", 1.0))
        l1 = p.get("penalty", "l2") == "l1"
        # sklearn's C on summed loss -> regParam on mean loss.  Features are
        # standardized inside MLlib (near-constant encodings otherwise stall
        # L-BFGS), so the penalty applies to standardized coefficients.
        return LogisticRegression(regParam=1.0 / (c * max(n_train, 1)), elasticNetParam=1.0 if l1 else 0.0,
                                  standardization=True, maxIter=int(p.get("max_iter", 100)), **common, **weighted)
    if spec.mdl_type == "linear":            # linear booster: alpha (l1) + lambda (l2) on summed loss
        a, lam = float(p.get("alpha", 0.0)), float(p.get("lambda", 1.0))
        return LogisticRegression(regParam=(a + lam) / max(n_train, 1),
                                  elasticNetParam=a / (a + lam) if a + lam > 0 else 0.0,
                                  standardization=True, maxIter=int(p.get("max_iter", 100)), **common, **weighted)
    if spec.mdl_type == "gbt":
        kw = dict(stepSize=float(p.get("learning_rate", p.get("eta", 0.1))),
                  maxIter=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 5)),
                  subsamplingRate=float(p.get("subsample", 1.0)), seed=seed, **common, **weighted)
        if "colsample_bytree" in p:
            kw["featureSubsetStrategy"] = str(float(p["colsample_bytree"]))
        if "min_child_weight" in p:
            kw["minInstancesPerNode"] = max(1, int(math.floor(float(p["min_child_weight"]))))
        if "min_child_samples" in p:
            kw["minInstancesPerNode"] = max(1, int(p["min_child_samples"]))
        if "max_bin" in p:
            kw["maxBins"] = int(p["max_bin"])
        return GBTClassifier(**kw)
    if spec.mdl_type == "rf":
        kw = dict(numTrees=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 8)),
                  seed=seed, **common, **weighted)
        if "min_samples_leaf" in p:
            kw["minInstancesPerNode"] = int(p["min_samples_leaf"])
        return RandomForestClassifier(**kw)
    if weight_col:
        raise ValueError("the perceptron takes no class weights")
    return MultilayerPerceptronClassifier(layers=[int(p["n_features"]), *list(p.get("hidden", (128, 64))), 2],
                                          maxIter=int(p.get("max_iter", 100)), seed=seed,
                                          stepSize=float(p.get("learning_rate", 0.03)), **common)


# --------------------------------------------------------------------------
# Named configurations of the reference (a representative set),
# with its parameter names; MLlib translation happens in ``build_estimator``.
REGISTRY: dict[str, ModelSpec] = {s.name: s for s in [
    ModelSpec("lr1", "lr", {"C": 0.8, "penalty": "l2"}, bag=1, split=1, fold=5),
    ModelSpec("lr2", "lr", {"C": 2, "penalty": "l2"}, bag=3, split=1, fold=5),
    ModelSpec("lr3", "lr", {"C": 0.8, "penalty": "l2"}, bag=1, split=1, fold=5),
    ModelSpec("lr4", "lr", {"C": 1, "penalty": "l1"}, bag=1, split=1, fold=5),
    ModelSpec("lr5", "lr", {"C": 1, "penalty": "l2"}, bag=3, split=1, fold=5),
    ModelSpec("stack_lr1", "lr", {"penalty": "l2"}, bag=2, split=1, fold=5),
    ModelSpec("stack_lr11", "lr", {"penalty": "l2", "C": 0.8}, bag=2, split=1, fold=5),
    ModelSpec("stack_lr2", "lr", {"penalty": "l2", "C": 2}, bag=3, split=1, fold=5),
    ModelSpec("xgbl", "linear", {"alpha": 0.0001, "lambda": 2, "seed": 1024}, bag=3, split=1, fold=5),
    ModelSpec("xgb1", "newton", {"learning_rate": 0.04, "n_estimators": 800, "seed": 1024, "colsample_bytree": 0.8,
                              "gamma": 0.59, "reg_alpha": 10.4, "reg_lambda": 5, "max_depth": 5,
                              "min_child_weight": 9.15, "subsample": 0.8, "n_jobs": 8}, bag=1, split=1, fold=5),
    *[ModelSpec(name, "forest", {"max_leaf": leaves, "algorithm": "RGF", "loss": "Log", "l2": l2, "sl2": l2, "normalize": False,
                                 "min_samples_leaf": least, "n_iter": None, "opt_interval": 100, "learning_rate": rate,
                                 "calc_prob": "sigmoid", "n_jobs": -1, "memory_policy": "generous", "verbose": 1},
                bag=1, split=1, fold=5)
      for name, leaves, l2, least, rate in [
          ("rgf1", 290, 0.011, 8, 0.4), ("shadow.rgf1", 1000, 0.01, 10, 0.5), ("shadow.rgf3", 1000, 0.01, 15, 0.4)]],
    ModelSpec("mlp", "mlp", {"hidden": (128, 64)}, bag=1, split=1, fold=5),
    ModelSpec("shadow.xgb1", "newton", {"objective": "binary:logistic", "learning_rate": 0.07, "n_estimators": 400,
                                        "max_depth": 4, "scale_pos_weight": 1.6, "seed": 1024, "subsample": 0.9,
                                        "colsample_bytree": 0.8, "min_child_weight": 6, "reg_lambda": 1.3,
                                        "reg_alpha": 8.0, "n_jobs": 7}),
    ModelSpec("shadow.xgb2", "newton", {"objective": "binary:logistic", "learning_rate": 0.07, "n_estimators": 400,
                                        "max_depth": 4, "scale_pos_weight": 1.8, "seed": 1024, "subsample": 0.9,
                                        "subsample_freq": 10, "colsample_bytree": 0.8, "min_child_samples": 500,
                                        "n_jobs": 7}),
    ModelSpec("shadow.lgb2", "newton", {"objective": "binary:logistic", "learning_rate": 0.02, "n_estimators": 1000,
                                        "num_leaves": 16, "seed": 1024, "subsample": 0.8, "subsample_freq": 4,
                                        "colsample_bytree": 0.3, "n_jobs": 7}),
    ModelSpec("shadow.lgb3", "newton", {"objective": "binary:logistic", "learning_rate": 0.02, "n_estimators": 800,
                                        "num_leaves": 18, "seed": 1024, "subsample": 0.8, "subsample_freq": 4,
                                        "colsample_bytree": 0.5, "n_jobs": 7}),
    *[ModelSpec(f"rk.{name}", "newton", {"objective": "rank:pairwise", "learning_rate": 0.1, "n_estimators": 1000,
                                         "colsample_bytree": share, "gamma": gamma, "max_depth": depth,
                                         "min_child_weight": least, "scale_pos_weight": weight, "subsample": rows,
                                         "silent": 1, "n_jobs": 8, "seed": 99}, bag=3, split=1, fold=5)
      for name, share, gamma, depth, least, weight, rows in [
          ("xgb1", 0.4488, 2.511, 3, 19, 1.99, 0.9831), ("xgb2", 0.554, 9.6, 3, 19, 1.5, 0.92),
          ("xgb3", 0.407, 2.17, 4, 9.4, 1.3, 0.76)]],
    # smaller models of this library, under names of their own
    ModelSpec("pairwise_small", "newton", {"objective": "rank:pairwise", "learning_rate": 0.3, "n_estimators": 8, "max_depth": 3,
                                           "subsample": 0.9, "colsample_bytree": 0.8}),
    ModelSpec("newton_small", "newton", {"learning_rate": 0.3, "n_estimators": 12, "max_depth": 4, "subsample": 0.8,
                                         "colsample_bytree": 0.8, "reg_alpha": 0.5, "reg_lambda": 1.3, "gamma": 0.1}),
    ModelSpec("leafwise_small", "newton", {"learning_rate": 0.3, "n_estimators": 8, "num_leaves": 8,
                                           "subsample": 0.8, "subsample_freq": 4, "colsample_bytree": 0.8}),
    ModelSpec("forest_small", "forest", {"max_leaf": 60, "tree_leaves": 6, "opt_interval": 20, "l2": 0.01, "learning_rate": 0.5}),
    ModelSpec("gbt_small", "gbt", {"learning_rate": 0.1, "n_estimators": 20, "max_depth": 4, "subsample": 0.8}),
    ModelSpec("rf_small", "rf", {"n_estimators": 20, "max_depth": 6}),
    ModelSpec("mlp_small", "mlp", {"hidden": (16,), "max_iter": 40}),
]}
# --------------------------------------------------------------------------


def lookup(name: str) -> ModelSpec:
    try:
        return REGISTRY[name]
    except KeyError:
        raise KeyError(f"model {name!r} is not registered; known: {sorted(REGISTRY)}") from None


def positive_probability(col: str = "probability") -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]
