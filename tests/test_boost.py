"""Second-order trees against closed forms and a brute-force grower."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators.metrics import gini
from foldwise.plans import boost as bo
from foldwise.plans import models as mo
from foldwise.plans import oof as oo
from foldwise.plans.boost import BoostParams, fit_boosted, learning_curve_gini, predict_boosted

SCHEMA = "id long, split string, fold int, target int, a double, b double, c double"


def drawn(n, seed=1, nulls=0.0):
    r = np.random.default_rng(seed)
    a, b, c = r.integers(0, 12, n) * 1.0, r.integers(0, 7, n) * 1.0, r.integers(0, 30, n) * 1.0
    y = (r.random(n) < 1 / (1 + np.exp(-(0.5 * (a > 5) * (b > 2) * 4 - 1 + 0.1 * (c % 5))))).astype(int)
    hide = r.random(n) < nulls
    return [(i, "train", int(i % 2), int(y[i]), None if hide[i] else float(a[i]), float(b[i]), float(c[i])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stump_value(spark, **params):
    """Leaf values of a one-split tree on a column of two values; model 0 learns from fold 1."""
    rows = [(i, "train", 1, int(i % 10 < (7 if i < 60 else 2)), 1.0 if i < 60 else 2.0, 0.0, 0.0) for i in range(100)]
    model = fit_boosted(frame(spark, rows), [["a"]], BoostParams(n_estimators=1, max_depth=1, learning_rate=1.0, **params))
    return model.trees[0][0]


def test_leaves_follow_the_closed_form(spark):
    # 60 rows with 42 positives, 40 rows with 8: gradient sums 30 - 42 and 20 - 8, hessian sums 15 and 10
    for lam, alpha in ((0.0, 0.0), (3.0, 0.0), (0.0, 4.0), (2.5, 5.5)):
        tree = stump_value(spark, reg_lambda=lam, reg_alpha=alpha)
        got = sorted(v for v, f in zip(tree.value, tree.feature) if f < 0)
        assert got == pytest.approx([-(12 - alpha) / (10 + lam), (12 - alpha) / (15 + lam)])


def test_minimum_gain_blocks_the_split(spark):
    gain = 12 ** 2 / 15 + 12 ** 2 / 10 - 0.0
    assert stump_value(spark, reg_lambda=0.0, gamma=gain - 1e-6).feature[0] == 0
    assert stump_value(spark, reg_lambda=0.0, gamma=gain + 1e-6).feature == [-1]


def test_minimum_rows_and_hessian(spark):
    assert stump_value(spark, min_child_samples=40).feature[0] == 0
    assert stump_value(spark, min_child_samples=41).feature == [-1]
    assert stump_value(spark, min_child_weight=10.0).feature[0] == 0
    assert stump_value(spark, min_child_weight=10.1).feature == [-1]


def test_class_weight_moves_the_leaves(spark):
    tree = stump_value(spark, reg_lambda=0.0, scale_pos_weight=3.0)
    # 42 and 8 positives of weight 3: gradients (18 - 126) / 2 and (32 - 24) / 2, hessians (18 + 126) / 4, (32 + 24) / 4
    got = sorted(v for v, f in zip(tree.value, tree.feature) if f < 0)
    assert got == pytest.approx([-4 / 14, 54 / 36])


class Brute:
    """Best-first growth by trying every cut of every column on plain arrays, in exact fractions of a half."""

    def __init__(self, x, y, params):
        self.x, self.y, self.p, self.splits = x, y, params, []

    def score(self, rows):
        g, h = 0.5 * len(rows) - self.y[rows].sum(), 0.25 * len(rows)
        t = max(abs(g) - self.p.reg_alpha, 0.0)
        return t * t / (h + self.p.reg_lambda)

    def best(self, rows):
        found = None
        for f in range(self.x.shape[1]):
            for cut in np.unique(self.x[rows, f])[:-1]:
                left, right = rows[self.x[rows, f] <= cut], rows[self.x[rows, f] > cut]
                if min(len(left), len(right)) * 0.25 < self.p.min_child_weight:
                    continue
                gain = self.score(left) + self.score(right) - self.score(rows) - self.p.gamma
                if gain > 1e-12 and (found is None or gain > found[0]):
                    found = gain, left, right
        return found

    def leaves(self, count):
        held = [np.arange(len(self.y))]
        while len(held) < count:
            options = [(self.best(rows), i) for i, rows in enumerate(held)]
            options = [(o[0], i, o) for o, i in options if o]
            if not options:
                break
            _, i, (_, left, right) = max(options, key=lambda o: o[0])
            held[i:i + 1] = [left, right]
        return {tuple(sorted(rows.tolist())) for rows in held}


def test_best_first_growth_equals_brute_force(spark):
    rows = drawn(2000, 5)
    params = BoostParams(n_estimators=1, num_leaves=16, reg_alpha=0.7, gamma=0.05, min_child_weight=3.0)
    df = frame(spark, [(*r[:2], 1, *r[3:]) for r in rows])
    model = fit_boosted(df, [["a", "b", "c"]], params)
    tree = model.trees[0][0]
    x, y = np.array([r[4:] for r in rows]), np.array([r[3] for r in rows])
    bins = bo._bins(list(x.T), [np.array(model.edges[c]) for c in "abc"])
    leaf = tree.leaf_of(bins)
    got = {tuple(np.flatnonzero(leaf == i).tolist()) for i in np.unique(leaf)}
    assert len(got) == 16 and got == Brute(x, y, params).leaves(16)
    for i in np.unique(leaf):
        own = leaf == i
        g, h = 0.5 * own.sum() - y[own].sum(), 0.25 * own.sum()
        want = -math.copysign(max(abs(g) - 0.7, 0), g) / (h + 1.0) * 0.1
        assert tree.value[i] == pytest.approx(want, abs=1e-12)


def plain_margins(model, j, x):
    bins = bo._bins(list(x.T), [np.array(model.edges[c]) for c in model.columns[j]])
    out = np.zeros((len(model.trees[j]) + 1, len(x)))
    for i, tree in enumerate(model.trees[j]):
        out[i + 1] = out[i] + tree.values(bins)
    return out


def test_later_trees_follow_the_margins(spark):
    """Every leaf of every tree is the Newton step at the margins before it, refresh or not."""
    rows = drawn(600, 3, nulls=0.2)
    params = BoostParams(n_estimators=7, max_depth=3, learning_rate=0.5, reg_alpha=0.1)
    model = fit_boosted(frame(spark, rows), [["a", "b"], ["c", "a"]], params, refresh=3)
    for j, names in enumerate((["a", "b"], ["c", "a"])):
        own = [r for r in rows if r[2] != j]
        x = np.array([[np.nan if r[4 + "abc".index(c)] is None else r[4 + "abc".index(c)] for c in names] for r in own])
        y, margins = np.array([r[3] for r in own]), plain_margins(model, j, x)
        bins = bo._bins(list(x.T), [np.array(model.edges[c]) for c in names])
        for i, tree in enumerate(model.trees[j]):
            p = 1 / (1 + np.exp(-margins[i]))
            leaf = tree.leaf_of(bins)
            for node in np.unique(leaf):
                g, h = (p - y)[leaf == node].sum(), (p * (1 - p))[leaf == node].sum()
                want = -math.copysign(max(abs(g) - 0.1, 0), g) / (h + 1.0) * 0.5
                assert tree.value[node] == pytest.approx(want, abs=1e-7)


def test_null_rows_take_the_better_side(spark):
    rows = [(i, "train", 1, y, a, 0.0, 0.0) for i, (a, y) in enumerate(
        [(1.0, 0)] * 40 + [(2.0, 1)] * 40 + [(None, 1)] * 20)]
    tree = fit_boosted(frame(spark, rows), [["a"]], BoostParams(n_estimators=1, max_depth=1)).trees[0][0]
    assert (tree.feature[0], tree.cut[0], tree.null_left[0]) == (0, 1, False)
    rows = [(*r[:3], 0 if r[4] is None else r[3], *r[4:]) for r in rows]
    assert fit_boosted(frame(spark, rows), [["a"]], BoostParams(n_estimators=1, max_depth=1)).trees[0][0].null_left[0]


def trees_of(model):
    return [[(t.feature, t.cut, t.null_left, t.value) for t in own] for own in model.trees]


def test_partitions_do_not_change_the_trees(spark):
    params = BoostParams(n_estimators=5, num_leaves=6, subsample=0.7, subsample_freq=2, colsample_bytree=0.7, colsample_bylevel=0.7)
    df = frame(spark, drawn(800, 9, nulls=0.1))
    one = fit_boosted(df.coalesce(1), [["a", "b", "c"]] * 2, params)
    old = bo.CELLS
    try:
        bo.CELLS = 1                                   # every leaf a job of its own
        many = fit_boosted(df.repartition(13), [["a", "b", "c"]] * 2, params, refresh=2)
    finally:
        bo.CELLS = old
    assert trees_of(one) == trees_of(many)
    assert trees_of(one) != trees_of(fit_boosted(df, [["a", "b", "c"]] * 2, bo.with_seed(params, 5)))


def test_stage_table_equals_gini_of_truncated_models(spark):
    df = frame(spark, drawn(700, 4))
    model = fit_boosted(df, [["a", "b", "c"]] * 2, BoostParams(n_estimators=6, max_depth=2, learning_rate=0.4))
    curve = {(r["fold"], r["stage"]): r for r in learning_curve_gini(df, model, every=2).collect()}
    assert sorted(curve) == [(j, s) for j in range(2) for s in (2, 4, 6)]
    for (j, stage), row in curve.items():
        cut = bo.Boosted(model.params, model.columns, model.edges, [t[:stage] for t in model.trees])
        for column, held in (("valid_gini", True), ("train_gini", False)):
            part = df.filter((F.col("fold") == j) == held).withColumn("split", F.lit("test")).withColumn("fold", F.lit(None).cast("int"))
            scored = predict_boosted(part, cut).filter(F.col("fold") == j).join(df.select("id", "target"), "id")
            assert gini(scored).first()["gini"] == pytest.approx(row[column], abs=1e-12)


def test_early_stopping_uses_the_best_stage_and_ten_more(spark):
    r = np.random.default_rng(2)
    rows = [(i, "train", int(i % 2), int(r.random() < 0.5), float(r.integers(0, 50)), float(r.integers(0, 50)), 0.0) for i in range(400)]
    model = fit_boosted(frame(spark, rows), [["a", "b"]] * 2, BoostParams(n_estimators=60, max_depth=4, learning_rate=0.5), early_stop=8, refresh=5)
    for j in range(2):
        assert len(model.trees[j]) < 60 and len(model.trees[j]) - model.best[j] >= 8
        assert model.stages(j) == min(len(model.trees[j]), model.best[j] + 10)


def test_column_draws(spark):
    model = fit_boosted(frame(spark, drawn(500, 6)), [["a", "b", "c"]] * 2, BoostParams(n_estimators=8, max_depth=3, colsample_bytree=0.34))
    used = [{f for f in t.feature if f >= 0} for t in model.trees[0]]
    assert all(len(u) <= 1 for u in used) and len(set().union(*used)) > 1


def test_out_of_fold_plan(spark):
    df = frame(spark, drawn(900, 8) + [(5000 + i, "test", None, None, float(i), 3.0, 4.0) for i in range(12)])
    spec = mo.ModelSpec("n", "newton", {"eta": 0.5, "n_estimators": 10, "max_depth": 3, "lambda": 1.0, "n_jobs": 4})
    got = oo.oof_train(df, spec, ["a", "b"], k=2, te_cols=["c"], bags=2).cache()
    assert got.filter("split = 'train'").count() == 900 * 2 and got.filter("split = 'test'").count() == 12 * 2 * 2
    by_hand = oo.oof_train(df, spec, ["a", "b"], k=2, te_cols=["c"], bags=2, pos_weight=4)
    assert by_hand.agg(F.avg("pred")).first()[0] > got.agg(F.avg("pred")).first()[0]
    joined = got.filter("split = 'train' AND bag = 0").join(df.select("id", "target"), "id")
    assert gini(joined).first()["gini"] > 0.3


def test_odd_tables(spark):
    """One class, constant and all-NULL columns, one row, no test rows."""
    rows = [(i, "train", int(i % 2), 1, 2.0, None, 3.0) for i in range(20)]
    model = fit_boosted(frame(spark, rows), [["a", "b"]] * 2, BoostParams(n_estimators=2))
    assert all(len(t.feature) == 1 for own in model.trees for t in own)
    preds = predict_boosted(frame(spark, rows), model).collect()
    assert len(preds) == 20 and all(p["pred"] > 0.5 for p in preds)
    model = fit_boosted(frame(spark, rows[:1]), [["a"]] * 2, BoostParams(n_estimators=1))
    assert len(predict_boosted(frame(spark, rows[:1]), model).collect()) == 1


def test_names_are_checked():
    assert BoostParams.of({"eta": 0.5, "lambda": 2, "num_leaves": 7, "objective": "binary:logistic", "n_jobs": 3}) == \
        BoostParams(learning_rate=0.5, reg_lambda=2, num_leaves=7)
    for bad in ({"invented": 1}, {"objective": "multi:softmax"}):
        with pytest.raises(ValueError):
            BoostParams.of(bad)
    for spec in mo.REGISTRY.values():
        if spec.mdl_type == mo.BOOSTED:
            BoostParams.of(spec.param)


def test_no_step_repeats_earlier_trees(spark, monkeypatch):
    """The rows a tree grows on hold the margins of all trees before it, with and without stopping."""
    behind, grow = [], bo._grow
    monkeypatch.setattr(bo, "_grow", lambda growth, rows, models: behind.append(sum(map(len, growth.recent))) or grow(growth, rows, models))
    df, params = frame(spark, drawn(300, 5)), BoostParams(n_estimators=4, max_depth=2)
    plain = fit_boosted(df, [["a", "b"]] * 2, params)
    stopped = fit_boosted(df, [["a", "b"]] * 2, params, early_stop=4, refresh=3)
    assert behind == [0] * 8 and trees_of(plain) == trees_of(stopped)


def test_binary_cells_of_slices_and_empty_columns():
    import pyarrow as pa
    m = np.arange(12, dtype=np.uint16).reshape(4, 3)
    assert (bo._matrix(bo._cells(m).slice(1, 2), np.uint16) == m[1:3]).all()
    assert bo._cells(m).to_pylist() == [r.tobytes() for r in m]
    assert bo._matrix(bo._cells(np.zeros((3, 0))), float).shape == (3, 0)
    assert bo._matrix(pa.array([], pa.binary()), float).shape == (0, 0)
