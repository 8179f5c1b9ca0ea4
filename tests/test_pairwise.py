"""Pairwise ranking gradients and trees against sums over every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators.metrics import gini
from foldwise.plans import boost as bo
from foldwise.plans import models as mo
from foldwise.plans import oof as oo
from foldwise.plans import pairwise as pw
from foldwise.plans.boost import BoostParams, fit_boosted
from tests.test_boost import drawn, frame, plain_margins, trees_of


def by_pairs(score, y, w):
    """Gradient and hessian of every row, pair by pair."""
    g, h = np.zeros(len(y)), np.zeros(len(y))
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    if not len(pos) or not len(neg):
        return g, h
    norm = (w.sum()) / (w[pos].sum() * w[neg].sum())
    for i in pos:
        s = 1 / (1 + np.exp(score[i] - score[neg]))
        each = w[i] * w[neg] * norm
        g[i] -= (s * each).sum()
        h[i] += (s * (1 - s) * each).sum()
        g[neg] += s * each
        h[neg] += s * (1 - s) * each
    return g, h


def test_gradients_equal_the_sum_over_pairs(spark):
    r = np.random.default_rng(3)
    rows = [(i, int(r.random() < 0.2), float(r.integers(0, 40)) / 7, float(r.integers(1, 4)), int(i % 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, target int, pred double, w double, k int")
    got = {x.id: x for x in pw.pair_gradients(df, by=["k"], weight=F.col("w")).collect()}
    for k in (0, 1):
        own = [x for x in rows if x[4] == k]
        g, h = by_pairs(*(np.array([x[c] for x in own], float) for c in (2, 1, 3)))
        for x, a, b in zip(own, g, h):
            assert (got[x[0]].g, got[x[0]].h) == pytest.approx((a, b), rel=1e-9)
    assert sum(x.g for x in got.values()) == pytest.approx(0, abs=1e-9)


def test_crowded_buckets_stay_within_their_spread(spark):
    r = np.random.default_rng(5)
    score, y = r.normal(size=6000) * 2, (r.random(6000) < 0.3).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), float(score[i])) for i in range(6000)], "id long, target int, pred double")
    got = sorted(pw.pair_gradients(df).collect(), key=lambda x: x.id)
    g, h = by_pairs(score, y, np.ones(6000))
    spread = (score.max() - score.min()) / pw.BUCKETS
    most = np.where(y == 1, 6000 / y.sum(), 6000 / (6000 - y.sum()))       # a row's pairs weigh this much
    assert np.all(np.abs(np.array([x.g for x in got]) - g) <= most * spread / 4)


def test_rows_without_pairs(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7), (3, None, 0.1), (4, 1, None), (5, 1, float("nan"))], "id long, target int, pred double")
    got = {x.id: x for x in pw.pair_gradients(df).collect()}
    assert got[1].g == got[2].g == 0 and got[3].g is None and got[4].g is None and got[5].g is None
    assert pw.pair_gradients(df.limit(0)).count() == 0


def test_leaves_are_newton_steps_on_pairs(spark):
    """Every leaf of every tree follows from all pairs at the margins before it."""
    rows = drawn(500, 3, nulls=0.2)
    params = BoostParams(n_estimators=4, max_depth=2, learning_rate=0.5, scale_pos_weight=2.0, objective="pairwise")
    model = fit_boosted(frame(spark, rows), [["a", "b"], ["c", "a"]], params, refresh=2)
    for j, names in enumerate((["a", "b"], ["c", "a"])):
        own = [r for r in rows if r[2] != j]
        x = np.array([[np.nan if r[4 + "abc".index(c)] is None else r[4 + "abc".index(c)] for c in names] for r in own])
        y, margins = np.array([r[3] for r in own]), plain_margins(model, j, x)
        bins = bo._bins(list(x.T), [np.array(model.edges[c]) for c in names])
        for i, tree in enumerate(model.trees[j]):
            g, h = by_pairs(margins[i], y, np.where(y == 1, 2.0, 1.0))
            leaf = tree.leaf_of(bins)
            for node in np.unique(leaf):
                assert tree.value[node] == pytest.approx(-g[leaf == node].sum() / (h[leaf == node].sum() + 1.0) * 0.5, abs=1e-5)


def test_partitions_do_not_change_the_trees(spark):
    df = frame(spark, drawn(500, 9, nulls=0.1))
    params = BoostParams(n_estimators=3, max_depth=3, subsample=0.8, objective="pairwise")
    one = fit_boosted(df.coalesce(1), [["a", "b", "c"]] * 2, params)
    assert trees_of(one) == trees_of(fit_boosted(df.repartition(7), [["a", "b", "c"]] * 2, params, refresh=2))


def test_ranks_no_worse_than_the_logistic_loss(spark):
    df = frame(spark, drawn(1500, 8)).cache()
    found = {}
    for objective in ("rank:pairwise", "binary:logistic"):
        spec = mo.ModelSpec("n", "newton", {"objective": objective, "eta": 0.3, "n_estimators": 10, "max_depth": 3})
        preds = oo.oof_train(df, spec, ["a", "b", "c"], k=2).filter("split = 'train'")
        found[objective] = gini(preds.join(df.select("id", "target"), "id")).first()["gini"]
    assert found["rank:pairwise"] > found["binary:logistic"] - 0.02 and found["rank:pairwise"] > 0.3


def test_one_class_grows_no_split(spark):
    rows = [(i, "train", int(i % 2), 1, float(i % 5), 0.0, 0.0) for i in range(20)]
    model = fit_boosted(frame(spark, rows), [["a"]] * 2, BoostParams(n_estimators=2, reg_lambda=0.0, objective="pairwise"))
    assert all(t.feature == [-1] and t.value == [0.0] for own in model.trees for t in own)
