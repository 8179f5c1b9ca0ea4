"""Out-of-fold training and scoring (SURVEY X8-X11, X14, X15; plan 4.3 (e)).

Fold-independent features are prepared once and checkpointed.  Fold-wise
target encoding is joined once as an array per column (element j = encoding
without fold j), so fold model j just picks element j.  The k x bags fits are
submitted from a small thread pool and run as concurrent Spark jobs; every
prediction lands in one long table ``(id, model, split, fold, bag, pred)`` (and ``rep`` with repeated splits):
OOF rows carry their own fold, test rows one row per fold model.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.hashing import hash_mod
from foldwise.operators.folds import kfold_stratified, seed_schedule
from foldwise.operators.nested import fit_nested_encoding, nested_element
from foldwise.operators.target import TargetEncoding, fit_target_encoding
from foldwise.plans.boost import BoostParams, fit_boosted, learning_curve_gini, predict_boosted
from foldwise.plans.corrective import ForestParams, fit_forest
from foldwise.plans.linear import fit_linear, predict_linear
from foldwise.plans.models import BOOSTED, FOREST, ModelSpec, build_estimator, linear_penalties, class_weights, positive_probability
from foldwise.session import ensure_checkpoint_dir, materialize, released


def _fold_features(model: TargetEncoding | None, k: int, prefix: str = "_te_", suffix: str = "_avg", folds: int = 0, fold_col: str = ""):
    """Encodings for fold model k; of nested encodings (k * k elements) the one that also leaves out the row's own fold."""
    if model is None:
        return []
    if folds and model.k == folds * folds:
        return [nested_element(model, F.col(prefix + c), folds, F.col(fold_col), k).alias(c + suffix) for c in model.cols]
    prior = model.priors[k]
    return [F.coalesce(F.element_at(F.col(prefix + c), k + 1), F.lit(prior)).alias(c + suffix) for c in model.cols]


def oof_train(df: DataFrame, spec: ModelSpec, features: Sequence[str], label: str = "target",
              fold_col: str = "fold", k: int = 5, bags: int = 1, splits: int = 1, stratified: bool = False,
              seed: int = 1024, te_cols: Sequence[str] = (),
              te_params: tuple[float, float] = (200, 10), nested: bool = False, refold_per_bag: bool = False,
              bag_seed_step: int | None = None, upsample: bool = False, pos_weight: float | None = None,
              early_stop: bool = False, allow_drop: bool = False, parallelism: int = 2, id_col: str = "id",
              split_col: str = "split") -> DataFrame:
    """X8 (+X4 stratified folds, X5 repeated splits, X9 folds re-drawn per bag, X10 learner seeds per bag,
    X11 upsampling of the train side, M1 early stopping on the held-out fold, M6 class weights).  ``nested``
    encodes the train rows of a fold model without their own fold, too (operators/nested.py).

    The learner seed follows ``seed_schedule`` (split, fold, bag), or moves by ``bag_seed_step`` per
    bag when that is given.  ``pos_weight`` defaults to the spec's ``scale_pos_weight``.  At most
    ``parallelism`` fits run at a time, as each holds a cached copy of its train rows."""
    from pyspark.ml.feature import VectorAssembler

    pos_weight = spec.param.get("scale_pos_weight") if pos_weight is None else pos_weight
    base = df
    runs = [(s, b) for s in range(splits) for b in range(bags)]
    fold_of: dict[tuple[int, int], str] = {}
    for s, b in runs:
        own = refold_per_bag or b == 0
        if not own:
            fold_of[s, b] = fold_of[s, 0]
            continue
        draw = seed + 11 * s + (10 * b if refold_per_bag else 0)      # X9: fold seed 1024 + 10 * bag
        fc = fold_of[s, b] = f"_fold_s{s}_b{b}"
        if stratified:
            base = kfold_stratified(base, k, draw, label, id_col, out=fc)
        elif s == 0 and b == 0 and not refold_per_bag:
            base = base.withColumn(fc, F.col(fold_col))
        else:
            base = base.withColumn(fc, F.when(F.col(split_col) == "train", hash_mod(draw, id_col, k).cast("int")))

    te_models: dict[str, TargetEncoding | None] = dict.fromkeys(fold_of.values())
    if te_cols:
        for fc in te_models:
            fit = fit_nested_encoding if nested else fit_target_encoding
            te_models[fc] = fit(base, list(te_cols), label, fc, k, te_params[0], te_params[1])
            base = te_models[fc].attach(base, F.col("enc"), prefix=f"_te{fc}_")
    # only what the fold models read is written (column pruning before the copy)
    arrays = [f"_te{fc}_{c}" for fc, m in te_models.items() if m is not None for c in m.cols]
    keep = list(dict.fromkeys([id_col, split_col, label, *te_models, *features, *arrays]))
    prepared = materialize(base.select(*keep), "oof-prepared")

    if spec.mdl_type in (BOOSTED, FOREST, "lr", "linear"):
        return _oof_joint(prepared, spec, features, label, k, runs, splits, fold_of, te_models, seed, bag_seed_step,
                          upsample, pos_weight, early_stop, allow_drop, id_col, split_col)
    sizes = {}
    for fc in te_models:
        for r in prepared.groupBy(fc).count().collect():
            sizes[fc, r[fc]] = r["count"]

    def one(task):
        s, b, j = task
        fc = fold_of[s, b]
        te = te_models[fc]
        names = list(features) + ([c + "_avg" for c in te.cols] if te is not None else [])
        rows = prepared.select(id_col, split_col, label, fc, *features, *_fold_features(te, j, f"_te{fc}_", "_avg", k, fc))
        n_train = sum(v for (f, value), v in sizes.items() if f == fc and value is not None and value != j)
        learner_seed = seed + bag_seed_step * b if bag_seed_step is not None else seed_schedule(seed, s, j, b)
        train = rows.filter(F.col(fc).isNotNull() & (F.col(fc) != j))
        if upsample:
            train = train.unionByName(train.filter(F.col(label) == 1))
        stop = early_stop and spec.mdl_type == "gbt"
        if stop:                                  # the held-out rows come once, whatever was resampled
            held = rows.filter(F.col(fc) == j).withColumn("_is_valid", F.lit(True))
            train = train.withColumn("_is_valid", F.lit(False)).unionByName(held)
        weight_col = None
        if pos_weight is not None:
            train = class_weights(train, label, pos_weight, "_w")
            weight_col = "_w"
        est = build_estimator(spec, n_train, "features", label, weight_col, learner_seed, allow_drop)
        if stop:
            est = est.setValidationIndicatorCol("_is_valid")
            est.set(est.getParam("validationTol"), 0.01)
        asm = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
        model = est.fit(asm.transform(train))
        score = rows.filter((F.col(fc) == j) | (F.col(split_col) == "test"))
        pred = model.transform(asm.transform(score))
        return pred.select(id_col, F.lit(spec.name).alias("model"), split_col,
                           F.lit(j).cast("int").alias("fold"), F.lit(b).cast("int").alias("bag"),
                           F.lit(s).cast("int").alias("rep"), positive_probability().alias("pred"))

    tasks = [(s, b, j) for s, b in runs for j in range(k)]
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(tasks)))) as pool:
        parts = list(pool.map(one, tasks))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if splits > 1 else out.drop("rep")


EARLY_STOP = 50        # stages without a better held-out Gini (fixed value of the reference's runs)


def _oof_joint(prepared: DataFrame, spec: ModelSpec, features, label: str, k: int, runs, splits: int, fold_of, te_models,
               seed: int, bag_seed_step, upsample: bool, pos_weight, early_stop, allow_drop: bool, id_col: str,
               split_col: str) -> DataFrame:
    """Learners whose fold models are fitted together (plans/boost.py, plans/corrective.py, plans/linear.py).  A positive row that
    upsampling doubles has weight 2; ``early_stop`` may be a number of stages."""
    weighted = F.lit(2.0 if upsample else 1.0)
    if spec.mdl_type == BOOSTED:
        params = BoostParams.of(spec.param)
        if pos_weight is not None:
            params = replace(params, scale_pos_weight=float(pos_weight))
        patience = EARLY_STOP if early_stop is True else int(early_stop)
    elif spec.mdl_type == FOREST:
        params = ForestParams.of(spec.param)
        if pos_weight is not None:
            params = replace(params, scale_pos_weight=float(pos_weight))
    else:
        penalty = linear_penalties(spec, allow_drop)
        weighted = weighted * F.lit(1.0 if pos_weight is None else float(pos_weight))
    weight = F.when(F.col(label) == 1, weighted).otherwise(F.lit(1.0))
    parts, shared = [], {}
    for s, b in runs:
        fc, bag = fold_of[s, b], F.lit(b).cast("int")
        te = te_models[fc]
        own = [_fold_features(te, j, f"_te{fc}_", f"_avg_{j}", k, fc) for j in range(k)]
        rows = prepared.select(id_col, split_col, label, fc, *features, *[c for cols in own for c in cols],
                               weight.alias("_weight"))
        names = [list(features) + ([f"{c}_avg_{j}" for c in te.cols] if te is not None else []) for j in range(k)]
        if spec.mdl_type == BOOSTED:
            step = seed + bag_seed_step * b if bag_seed_step is not None else seed_schedule(seed, s, 0, b)
            model = fit_boosted(rows, names, replace(params, seed=step), label, fc, id_col, "_weight", patience)
            pred = predict_boosted(rows, model, label, fc, id_col, split_col)
        elif spec.mdl_type == FOREST:
            if fc not in shared:
                shared[fc] = fit_forest(rows, names, params, label, fc, id_col, "_weight")
            pred = predict_boosted(rows, shared[fc], label, fc, id_col, split_col)
        else:
            if fc in shared:                         # nothing is drawn: bags on the same folds are the same model, predicted once
                continue
            shared[fc] = fit_linear(rows, names, **penalty, label=label, fold_col=fc, weight_col="_weight")
            pred = predict_linear(rows, shared[fc], fc, id_col, split_col)
            bag = F.explode(F.array(*[F.lit(other).cast("int") for r, other in runs if fold_of[r, other] == fc]))
        parts.append(pred.select(id_col, F.lit(spec.name).alias("model"), split_col, "fold",
                                 bag.alias("bag"), F.lit(s).cast("int").alias("rep"), "pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if splits > 1 else out.drop("rep")


def learning_curve(df: DataFrame, spec: ModelSpec, features: Sequence[str], label: str = "target",
                   fold_col: str = "fold", k: int = 5, every: int = 1, id_col: str = "id") -> DataFrame:
    """Exact Gini of all fold models on their train and held-out rows after every ``every`` stages."""
    if spec.mdl_type != BOOSTED:
        raise ValueError(f"no stages in a model of type {spec.mdl_type!r}")
    kept = materialize(df.select(id_col, label, fold_col, *features), "curve")
    model = fit_boosted(kept, [list(features)] * k, BoostParams.of(spec.param), label, fold_col, id_col)
    return learning_curve_gini(kept, model, label, fold_col, id_col, every)


def permute_columns(df: DataFrame, cols: Sequence[str], seed: int = 2024, id_col: str = "id",
                    prefix: str = "shadow_") -> DataFrame:
    """A seeded permutation of ``cols`` across rows: the row with the r-th
    smallest id receives the values of the row with the r-th smallest
    md5(seed:id).  Both numberings are bucketed running counts (no global
    window), joined on the rank."""
    from foldwise.operators.ordered import dense_codes
    keyed = df.select(id_col, F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))).alias("_h"), *cols)
    by_id = dense_codes(keyed.select(id_col), [], [id_col], "_r")
    by_hash = dense_codes(keyed.select("_h", id_col), [], ["_h", id_col], "_r") \
        .join(keyed.select(id_col, *cols), id_col).select("_r", *[F.col(c).alias(prefix + c) for c in cols])
    shadows = by_id.join(by_hash, "_r").drop("_r")
    return df.join(shadows, id_col)


def shadow_importance(df: DataFrame, spec: ModelSpec, features: Sequence[str], label: str = "target",
                      seed: int = 2024, allow_drop: bool = False) -> DataFrame:
    """Importance of each feature next to the importance of its permuted
    (shadow) copy, from one tree-ensemble fit on the labelled rows."""
    from pyspark.ml.feature import VectorAssembler
    lab = df.filter(F.col(label).isNotNull())
    names = list(features) + [f"shadow_{c}" for c in features]
    # MLlib reads its input several times.  A reliable checkpoint runs numbering and joins once and, unlike a table or a
    # cached plan, keeps the splits and their order, which the forest's draws follow.
    ensure_checkpoint_dir(df.sparkSession)
    with released(df.sparkSession):
        with_shadow = permute_columns(lab, list(features), seed).select(label, *names).checkpoint()
    asm = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    est = build_estimator(spec, 1, "features", label, None, seed, allow_drop)
    imp = est.fit(asm.transform(with_shadow)).featureImportances.toArray()
    n = len(features)
    best_shadow = max(imp[n:]) if n else 0.0
    rows = [(c, float(imp[i]), float(imp[n + i]), bool(imp[i] > best_shadow)) for i, c in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, shadow_importance double, "
                                                 "beats_shadows boolean")


def oof_tree(df: DataFrame, col: str, label: str = "target", fold_col: str = "fold", k: int = 5, id_col: str = "id",
             split_col: str = "split") -> DataFrame:
    """X8 with one unpruned regression tree on one column: (id, split, fold, pred)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    asm = VectorAssembler(inputCols=[col], outputCol="features")
    data = materialize(df.select(id_col, split_col, label, fold_col, col), "oof-tree")
    est = DecisionTreeRegressor(featuresCol="features", labelCol=label, maxDepth=8, minInstancesPerNode=1)
    parts = []
    for j in range(k):
        model = est.fit(asm.transform(data.filter(F.col(fold_col).isNotNull() & (F.col(fold_col) != j))))
        score = asm.transform(data.filter((F.col(fold_col) == j) | (F.col(split_col) == "test")))
        parts.append(model.transform(score).select(id_col, split_col, F.lit(j).cast("int").alias("fold"),
                                                   F.col("prediction").alias("pred")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
