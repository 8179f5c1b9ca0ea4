"""Edge cases of the operators: NULL keys, one-class groups, constant columns, unmatched features,
overflow, odd run names, weights, resampling, storage."""

import os

import pytest
from pyspark.sql import functions as F

from foldwise.functions import scalar as fn
from foldwise.operators import cluster as cl
from foldwise.operators import encode as en
from foldwise.operators import joins
from foldwise.operators import metrics as me
from foldwise.operators import schema as sm
from foldwise.operators import stats as st
from foldwise.operators import target as te
from foldwise.plans import models as mo
from foldwise.plans import oof as oo
from foldwise.queries_models import NUMS, model_frame
from foldwise.session import ensure_checkpoint_dir, materialize, released
from foldwise.sources import features as sf
from foldwise.sources import fixtures as fx
from foldwise.sources import predictions as pr

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    return model_frame(spark, SF).persist()


def total(preds):
    return preds.filter("split = 'train'").agg(F.sum("pred")).first()[0]


@pytest.mark.parametrize("name", ["lr1", "xgbl", "gbt_small", "rf_small"])
def test_class_weight_moves_predictions(frame, name):
    spec = mo.lookup(name)
    plain, weighted = total(oo.oof_train(frame, spec, NUMS, k=2)), total(oo.oof_train(frame, spec, NUMS, k=2, pos_weight=5))
    assert weighted > plain * 1.02
    by_spec = mo.ModelSpec(name, spec.mdl_type, {**spec.param, "scale_pos_weight": 5})
    assert total(oo.oof_train(frame, by_spec, NUMS, k=2)) == pytest.approx(weighted)


def test_perceptron_refuses_weights(frame):
    spec = mo.ModelSpec("m", "mlp", {"n_features": len(NUMS), "hidden": (4,), "max_iter": 5})
    with pytest.raises(ValueError):
        oo.oof_train(frame, spec, NUMS, k=2, pos_weight=2)


def test_parameters_are_rejected_by_default(frame):
    with pytest.raises(ValueError):
        oo.oof_train(frame, mo.ModelSpec("x", "gbt", mo.lookup("xgb1").param), NUMS, k=2)
    with pytest.raises(ValueError):
        oo.oof_train(frame, mo.ModelSpec("x", "newton", {"invented": 1}), NUMS, k=2)
    with pytest.raises(ValueError):
        mo.build_estimator(mo.ModelSpec("x", "lr", {"invented": 1}), 10, allow_drop=True)


def test_early_stop_keeps_copies_and_weights(frame):
    spec = mo.lookup("gbt_small")
    base = total(oo.oof_train(frame, spec, NUMS, k=2, early_stop=True))
    up = total(oo.oof_train(frame, spec, NUMS, k=2, early_stop=True, upsample=True))
    heavy = total(oo.oof_train(frame, spec, NUMS, k=2, early_stop=True, pos_weight=2))
    assert up > base * 1.01 and heavy > base * 1.01


def test_repeated_and_stratified_folds(frame):
    spec = mo.lookup("lr1")
    twice = oo.oof_train(frame, spec, NUMS, splits=2)
    n = frame.filter("split = 'train'").count()
    assert twice.filter("split = 'train'").count() == 2 * n
    folds = twice.filter("split = 'train'").groupBy("id").agg(F.countDistinct("fold").alias("n"))
    assert folds.filter("n = 2").count() > n / 3            # the splits are drawn anew
    strat = oo.oof_train(frame, spec, NUMS, stratified=True).filter("split = 'train'")
    share = strat.join(frame.select("id", "target"), "id").groupBy("fold").agg(F.sum("target").alias("p")).collect()
    assert max(r.p for r in share) - min(r.p for r in share) <= 1


def test_string_key_with_nulls(spark):
    df = spark.createDataFrame([(None, 5), (5, None), (None, None)], "a int, b int")
    assert [r.k for r in df.select(fn.string_key("a", "b").alias("k")).collect()] == ["nan_5", "5_nan", "nan_nan"]


def test_one_class_group_has_no_gini(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 0, 0.1), ("b", 1, 0.5), ("b", 1, 0.7)], "g string, target int, pred double")
    assert {r.g: r.gini for r in me.gini(df, by=["g"]).collect()} == {"a": 1.0, "b": None}
    rows = [(i, "m", "train", i % 2, 0, float(i)) for i in range(6)]
    preds = spark.createDataFrame(rows, "id long, model string, split string, fold int, bag int, pred double")
    labels = spark.createDataFrame([(i, int(i >= 2 and i % 2 == 0)) for i in range(6)], "id long, target int")
    got = me.cv_summary(preds, labels).first()
    assert got.folds == 1 and got.mean_gini == 1.0


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1, 7.0), (2, 7.0), (3, None)], "id int, x double")
    assert [r.x_bin for r in en.equal_width_bins(df, ["x"], 50).orderBy("id").collect()] == [24, 24, -1]
    row = st.column_stats(df, ["x"]).first()
    assert row.n == 2 and row["skew"] is None and row["median"] == 7.0


def test_narrowing_keeps_large_doubles(spark):
    df = spark.createDataFrame([(1e300, 1.5, float("inf"))], "a double, b double, c double")
    out = sm.narrow_types(df)
    assert dict(out.dtypes) == {"a": "double", "b": "float", "c": "float"} and out.first().a == 1e300


def test_feature_join_checks_both_sides(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    feats = spark.createDataFrame([(1, 0.5)], "id long, f double")
    with pytest.raises(ValueError, match="no entry"):
        sf.join_feature_table(rows, feats)
    assert sf.join_feature_table(rows, feats, check=False).count() == 2
    with pytest.raises(ValueError, match="feature table"):
        sf.join_feature_table(rows, feats.union(feats).union(spark.createDataFrame([(2, 1.0)], "id long, f double")))
    with pytest.raises(ValueError, match="rows"):
        sf.join_feature_table(rows.union(rows), feats.union(spark.createDataFrame([(2, 1.0)], "id long, f double")))


def test_odd_run_names(spark):
    df = spark.createDataFrame([("20171122-0729-m-0.28400-null--0.00793",), ("nonsense",), (None,)], "run string")
    got = pr.parse_run_names(df).collect()
    assert (got[0].model, got[0].mean_gini, got[0].full_gini, got[0].std_gini) == ("m", 0.284, None, -0.00793)
    assert got[1].mean_gini is None and got[2].mean_gini is None


def test_noise_does_not_depend_on_partitioning(spark):
    df = spark.range(2000).select("id", F.lit(1.0).alias("x"))
    noisy = lambda d: dict(d.select("id", fn.add_noise(F.col("x"), 0.1, 7)).collect())
    a = noisy(df)
    assert a == noisy(df.repartition(7))
    assert abs(sum(a.values()) / 2000 - 1) < 0.01
    assert 0.09 < (sum((v - 1) ** 2 for v in a.values()) / 2000) ** 0.5 < 0.11


def test_hot_and_null_values_of_a_shuffled_dictionary(spark):
    rows = [(i, i % 2 if i % 10 else None, None if i % 7 == 0 else ("hot" if i % 3 else f"v{i % 50}"), i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, target int, c string, fold int")
    model = te.fit_target_encoding(df, ["c"], min_samples_leaf=5, smoothing=3)
    near = {r.id: r.c_avg for r in model.transform_fold(df).collect()}
    spark.conf.set("foldwise.broadcast.maxBytes", "100")
    try:
        far = model.transform_fold(df)
        assert far.columns == [*df.columns, "c_avg"]
        assert {r.id: r.c_avg for r in far.collect()} == near
    finally:
        spark.conf.unset("foldwise.broadcast.maxBytes")


def test_encodings_join_once_and_need_no_union(spark):
    plan = te.oof_mean(fx.policy_folds(spark, SF), fx.CAT_FEATURES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == len(fx.CAT_FEATURES) and "Union" not in plan


def test_broadcast_is_bounded_by_bytes(spark):
    df, side = spark.range(10), spark.range(10).withColumn("t", F.lit("x"))
    text = lambda **kw: joins.join_stats(df, side, "id", **kw)._jdf.queryExecution().logical().toString()
    assert "broadcast" in text(n_stats=1000).lower()
    assert "broadcast" not in text(n_stats=1000, width=1 << 20).lower()


def test_one_hot_threshold_comes_before_the_cap(spark):
    rows = [(i, f"rare{i}") for i in range(50)] + [(i, "often") for i in range(50, 60)]
    df = spark.createDataFrame(rows, "id long, c string")
    with pytest.raises(ValueError):
        en.one_hot(df, ["c"], max_categories=10)
    assert en.one_hot(df, ["c"], threshold=5, max_categories=10).columns == ["id", "c_often"]
    wide = en.one_hot_sparse(df, ["c"], threshold=5)
    sums = {r.c: float(r.oh_c.toArray().sum()) for r in wide.collect()}
    assert sums["often"] == 1.0 and sums["rare3"] == 0.0
    sizes = en.one_hot_sparse(df, ["c"]).first().oh_c.size
    assert sizes == 51


def test_cluster_features_on_one_hot_rows(spark):
    p = fx.policy(spark, SF).select("id", "prio_cat", "seg_cat")
    wide = en.one_hot(p, ["prio_cat", "seg_cat"])
    vec = wide.select("id", F.array(*[F.col(f"`{c}`").cast("double") for c in wide.columns if c != "id"]).alias("v"))
    centers = cl.kmeans_centers(vec, "v", k=25, starts=2)
    out = cl.rbf_features(vec, "v", centers)
    assert len([c for c in out.columns if c.startswith("rbf_")]) == len(centers)
    row = out.first()
    want = [2.718281828459045 ** -(sum((a - b) ** 2 for a, b in zip(row.v, c)) ** 0.5) for _, c in centers]
    assert [row[f"rbf_{j}"] for j, _ in centers] == pytest.approx(want)


def test_storage_is_refused_without_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_released_storage_is_deleted(spark):
    base = ensure_checkpoint_dir(spark).replace("file:", "") + "/foldwise-tables"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    with released(spark):
        assert materialize(spark.range(10), "gone").count() == 10
    assert set(os.listdir(base)) == before
