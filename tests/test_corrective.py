"""Corrective forest against the ridge solution and the penalised logistic optimum on plain arrays."""

import numpy as np
import pytest

from foldwise.operators.metrics import gini
from foldwise.plans import models as mo
from foldwise.plans import oof as oo
from foldwise.plans.boost import _bins, predict_boosted
from foldwise.plans.corrective import ForestParams, fit_forest

SCHEMA = "id long, split string, fold int, target int, a double, b double, c double"
COLS = ["a", "b", "c"]


def drawn(n, seed=1):
    r = np.random.default_rng(seed)
    a, b, c = r.integers(0, 12, n) * 1.0, r.integers(0, 7, n) * 1.0, r.integers(0, 30, n) * 1.0
    y = (r.random(n) < 1 / (1 + np.exp(-(2.0 * (a > 5) * (b > 2) - 1 + 0.1 * (c % 5))))).astype(int)
    return [(i, "train", int(i % 2), int(y[i]), None if r.random() < 0.1 else float(a[i]), float(b[i]), float(c[i])) for i in range(n)]


def memberships(model, rows, j):
    """One column per leaf of model j, in the order of its trees and nodes, beside the leaf weights."""
    x = [np.array([np.nan if r[4 + i] is None else r[4 + i] for r in rows]) for i in range(len(model.columns[j]))]
    bins = _bins(x, [np.array(model.edges[c]) for c in model.columns[j]])
    columns, weights = [], []
    for tree in model.trees[j]:
        at = tree.leaf_of(bins)
        for node, feature in enumerate(tree.feature):
            if feature < 0:
                columns.append(at == node)
                weights.append(tree.value[node])
    return np.array(columns).T.astype(float), np.array(weights)


def test_squared_loss_is_the_ridge_solution(spark):
    rows = drawn(600)
    params = ForestParams(loss="LS", max_leaf=24, tree_leaves=4, opt_interval=8, n_iter=1, learning_rate=1.0, l2=0.01, min_samples_leaf=5)
    model = fit_forest(spark.createDataFrame(rows, SCHEMA).repartition(5), [COLS] * 2, params)
    for j in (0, 1):
        train = [r for r in rows if r[2] != j]
        m, got = memberships(model, train, j)
        s = np.array([2.0 * r[3] - 1 for r in train])
        assert len(model.trees[j]) == 6 and m.shape[1] == 24
        assert (m.sum(axis=1) == 6).all()
        want = np.linalg.solve(m.T @ m + 0.01 * len(train) * np.eye(24), m.T @ s)
        assert got == pytest.approx(want, abs=1e-6)


def test_weights_count_as_repeated_rows(spark):
    rows = drawn(300)
    params = dict(loss="LS", max_leaf=12, tree_leaves=4, opt_interval=4, n_iter=1, learning_rate=1.0, l2=0.01, min_samples_leaf=1)
    model = fit_forest(spark.createDataFrame(rows, SCHEMA), [COLS] * 2, ForestParams(scale_pos_weight=3.0, **params))
    train = [r for r in rows if r[2] != 0]
    m, got = memberships(model, train, 0)
    y = np.array([float(r[3]) for r in train])
    w = np.where(y == 1, 3.0, 1.0)
    want = np.linalg.solve((m * w[:, None]).T @ m + 0.01 * w.sum() * np.eye(m.shape[1]), m.T @ (w * (2 * y - 1)))
    assert got == pytest.approx(want, abs=1e-6)


def objective(m, y, weights, l2):
    z = m @ weights
    return (np.logaddexp(0, z) - y * z).sum() + l2 * len(y) / 2 * (weights ** 2).sum()


def test_logistic_rounds_fall_to_the_optimum(spark):
    rows, values = drawn(400, 3), []
    for rounds in (0, 1, 3, 40):
        params = ForestParams(max_leaf=8, tree_leaves=4, opt_interval=8, n_iter=rounds, learning_rate=1.0, l2=0.02, min_samples_leaf=5)
        model = fit_forest(spark.createDataFrame(rows, SCHEMA), [COLS] * 2, params)
        train = [r for r in rows if r[2] != 1]
        m, got = memberships(model, train, 1)
        y = np.array([float(r[3]) for r in train])
        values.append(objective(m, y, got, 0.02))
    assert values[0] > values[1] > values[2] > values[3]
    best = np.zeros(m.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-m @ best))
        h = (m * (p * (1 - p))[:, None]).T @ m + 0.02 * len(y) * np.eye(len(best))
        best -= np.linalg.solve(h, m.T @ (p - y) + 0.02 * len(y) * best)
    assert got == pytest.approx(best, abs=1e-5)


def test_forest_does_not_depend_on_partitions(spark):
    rows = drawn(500, 5)
    params = ForestParams(max_leaf=20, tree_leaves=5, opt_interval=10, l2=0.01, min_samples_leaf=5)
    a, b = (fit_forest(spark.createDataFrame(rows, SCHEMA).repartition(n), [COLS] * 2, params) for n in (1, 7))
    assert [t.feature for own in a.trees for t in own] == [t.feature for own in b.trees for t in own]
    assert [v for own in a.trees for t in own for v in t.value] == [v for own in b.trees for t in own for v in t.value]


def test_plain_cases(spark):
    rows = [(i, "train", i % 2, 1, 1.0, None, 2.0) for i in range(20)]
    model = fit_forest(spark.createDataFrame(rows, SCHEMA), [COLS] * 2, ForestParams(max_leaf=8, opt_interval=2, l2=0.01))
    assert all(len(t.feature) == 1 for own in model.trees for t in own) and len(model.trees[0]) == 1
    preds = predict_boosted(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(preds) == 20 and all(p["pred"] > 0.5 for p in preds)
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert len(predict_boosted(one, fit_forest(one, [["a"]] * 2, ForestParams())).collect()) == 1


def test_names_are_checked():
    for bad in ({"invented": 1}, {"loss": "Expo"}, {"algorithm": "RGF_Sib"}, {"max_leaf": 100_000}, {"calc_prob": "log"}):
        with pytest.raises(ValueError):
            ForestParams.of(bad)
    for spec in mo.REGISTRY.values():
        if spec.mdl_type == mo.FOREST:
            ForestParams.of(spec.param)


def test_out_of_fold_plan(spark):
    rows = drawn(800, 7)
    df = spark.createDataFrame(rows + [(1000 + i, "test", None, None, 3.0, 2.0, 1.0) for i in range(5)], SCHEMA)
    preds = oo.oof_train(df, mo.lookup("forest_small"), COLS, k=2).cache()
    assert preds.filter("split = 'test'").count() == 10 and preds.filter("split = 'train'").count() == 800
    judged = preds.filter("split = 'train'").join(df.select("id", "target"), "id")
    assert gini(judged, "target", "pred").first()["gini"] > 0.2
