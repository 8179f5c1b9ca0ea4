"""Model tests, stacking and registry behaviour."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from foldwise.operators import metrics as me
from foldwise.plans import models as mo
from foldwise.plans import oof as oo
from foldwise.plans import stack as sk
from foldwise.queries_models import NUMS, TE, model_frame
from foldwise.sources import fixtures as fx


@pytest.fixture(scope="module")
def frame(spark):
    return model_frame(spark, SF_MID)


def test_planted_signal_is_learned_and_oof_covers_train_once(spark, frame):
    preds = oo.oof_train(frame, mo.lookup("lr1"), NUMS, te_cols=TE)
    oof = preds.filter("split = 'train'")
    n_train = frame.filter("split = 'train'").count()
    assert oof.count() == n_train and oof.select("id").distinct().count() == n_train
    assert preds.filter("split = 'test'").count() == 5 * frame.filter("split = 'test'").count()
    g = me.gini(oof.join(frame.select("id", "target"), "id"), "target", "pred").collect()[0]["gini"]
    assert g > 0.5


def test_shuffled_label_gives_no_signal(spark, frame):
    from foldwise.functions.hashing import hash_mod
    noise = frame.withColumn("target", F.when(F.col("split") == "train", hash_mod(99, "id", 2).cast("int")))
    preds = oo.oof_train(noise, mo.lookup("lr1"), NUMS)
    g = me.gini(preds.filter("split = 'train'").join(noise.select("id", "target"), "id"),
                "target", "pred").collect()[0]["gini"]
    assert abs(g) < 0.08


def test_registry_lookup_error():
    with pytest.raises(KeyError):
        mo.lookup("rfg")           # N17: unknown names raise a clear error


def test_unsupported_params_rejected_when_strict():
    spec = mo.ModelSpec("x", "gbt", mo.lookup("xgb1").param)      # the same parameters for the MLlib learner
    assert mo.dropped_params(mo.lookup("xgb1")) == []
    with pytest.raises(ValueError):
        mo.build_estimator(spec, 100, allow_drop=False)
    mo.build_estimator(spec, 100, allow_drop=True)
    dropped = mo.dropped_params(spec)
    assert "reg_alpha" in dropped and "gamma" in dropped
    with pytest.raises(ValueError):
        mo.build_estimator(mo.ModelSpec("x", "gbt", {"invented": 1}), 100, allow_drop=True)


def test_stack_missing_model_is_an_error(spark):
    preds = fx.scores(spark, SF_MID).filter("NOT (model = 'm2' AND id % 97 = 0)")
    labels = fx.policy(spark, SF_MID).select("id", "target")
    with pytest.raises(ValueError):
        sk.check_complete(sk.stack_frame(preds, labels, list(fx.SCORE_MODELS)), list(fx.SCORE_MODELS))


def test_bag_average_is_mean_over_existing_rows(spark):
    # OOF is averaged over existing (bag) rows, not scaled by bags/folds
    from foldwise.sources.predictions import final_predictions
    rows = [(1, "m", "train", 0, 0, 0.2), (1, "m", "train", 0, 1, 0.4),
            (2, "m", "test", 0, 0, 0.1), (2, "m", "test", 1, 0, 0.3)]
    df = spark.createDataFrame(rows, "id long, model string, split string, fold int, bag int, pred double")
    got = {r["id"]: r["pred"] for r in final_predictions(df).collect()}
    assert got[1] == pytest.approx(0.3) and got[2] == pytest.approx(0.2)


def test_param_points_are_reproducible_and_sanitised():
    from foldwise.plans.sweep import param_grid, param_sanitise
    box = {"max_depth": (3, 8, "int"), "subsample": (0.5, 1.2, "lin"), "num_leaves": (8, 300, "int")}
    a, b = param_grid(box, 5, 7), param_grid(box, 5, 7)
    assert a == b
    s = [param_sanitise(p, ["max_depth", "num_leaves"], ["subsample"], ("num_leaves", "max_depth")) for p in a]
    assert all(isinstance(p["max_depth"], int) and 0 <= p["subsample"] <= 1 for p in s)
    assert all(p["num_leaves"] <= 2 ** p["max_depth"] for p in s)


def test_oof_with_class_weights_runs(spark):
    # M6: scale_pos_weight through weightCol on a tree learner
    df = model_frame(spark, "/root/testdata/sf0.001")
    preds = oo.oof_train(df, mo.lookup("rf_small"), NUMS, pos_weight=1.5)
    n_train = df.filter("split = 'train'").count()
    assert preds.filter("split = 'train'").count() == n_train
    assert preds.filter("pred IS NULL OR pred < 0 OR pred > 1").count() == 0


def test_shadow_importance_permutes_once(spark, monkeypatch):
    # The fit reads stored rows; before, every pass of MLlib over its input ran numbering and joins again
    from pyspark.ml.classification import RandomForestClassifier
    seen = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, data, *a: seen.append(
        data._jdf.queryExecution().optimizedPlan().toString()) or fit(self, data, *a))
    df = spark.createDataFrame([(i, i % 2 if i % 9 else None, float(i % 2 + i % 3), float(i % 7)) for i in range(200)],
                               "id int, target int, a double, b double")
    got = {r["feature"]: r for r in oo.shadow_importance(df, mo.lookup("rf_small"), ["a", "b"]).collect()}
    assert len(seen) == 1 and "Join" not in seen[0]
    assert got["a"]["beats_shadows"] and got["a"]["importance"] > got["a"]["shadow_importance"]
