"""The linear learners against a plain solver and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.plans import models as mo
from foldwise.plans import oof as oo
from foldwise.plans.linear import fit_linear, predict_linear, quadratic_step

NAMES = ["a", "b", "c", "d"]


def drawn(n=300, seed=3):
    r = np.random.default_rng(seed)
    x = np.c_[r.normal(size=n) * 100, r.integers(0, 2, n), r.normal(size=n) * 0.01, np.zeros(n)]
    x[:, 2] += 0.0001 * x[:, 0]                                   # correlated, far apart in scale
    y = (r.random(n) < 1 / (1 + np.exp(-(0.02 * x[:, 0] + x[:, 1] - 0.5)))).astype(int)
    return x, y


def frame(spark, x, y, test=0):
    rows = [(i, "train", i % 3, int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))]
    rows += [(10_000 + i, "test", None, None, 1.0, None, 0.5, 0.0) for i in range(test)]
    return spark.createDataFrame(rows, "id long, split string, fold int, target int, " + ", ".join(f"{c} double" for c in NAMES))


def solve(x, y, w, l1, l2):
    """Proximal Newton by cyclic descent on the exact one-dimensional problems, slowly and to the end."""
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    z = np.zeros(len(x))
    for _ in range(4000):
        moved = 0.0
        for i in range(len(b)):
            p1, p2 = (0.0, 0.0) if i == 0 else (l1, l2)
            for _ in range(20):
                p = 1 / (1 + np.exp(-z))
                g, h = (w * (p - y) * x[:, i]).sum(), (w * p * (1 - p) * x[:, i] ** 2).sum() + p2
                if h < 1e-14:
                    break
                pull = h * b[i] - (g + p2 * b[i])
                new = np.sign(pull) * max(abs(pull) - p1, 0) / h
                step = new - b[i]
                z += x[:, i] * step
                b[i] = new
                moved = max(moved, abs(step) * np.sqrt(h))
                if abs(step) * np.sqrt(h) < 1e-10:
                    break
        if moved < 1e-9:
            return b
    raise AssertionError("the plain solver did not end")


def objective(b, x, y, w, l1, l2):
    z = np.c_[np.ones(len(x)), x] @ b
    return (w * (np.logaddexp(0, z) - y * z)).sum() + l1 * np.abs(b[1:]).sum() + l2 / 2 * (b[1:] ** 2).sum()


@pytest.mark.parametrize("l1, l2", [(0.0, 1.0), (2.0, 0.0), (0.5, 3.0), (30.0, 0.1)])
def test_against_a_plain_solver(spark, l1, l2):
    x, y = drawn()
    w = np.where(y == 1, 1.5, 1.0)
    df = frame(spark, x, y).withColumn("weight", F.when(F.col("target") == 1, 1.5).otherwise(1.0))
    model = fit_linear(df, [NAMES] * 3, l1, l2, weight_col="weight")
    for j in range(3):
        use = np.arange(len(y)) % 3 != j
        want = solve(x[use], y[use], w[use], l1, l2)
        assert model.weights[j] == pytest.approx(want, abs=1e-6)
        assert model.objective[j] == pytest.approx(objective(want, x[use], y[use], w[use], l1, l2), abs=1e-8)
        assert model.weights[j][4] == 0


def test_many_blocks_fall_to_the_same_objective(spark):
    x, y = drawn()
    df = frame(spark, x, y)
    whole = fit_linear(df, [NAMES], 0.3, 2.0)
    parts = fit_linear(df, [NAMES], 0.3, 2.0, max_iter=300, block=2)
    assert parts.objective[0] == pytest.approx(whole.objective[0], rel=1e-7)


def test_l1_step_is_the_minimum_of_the_quadratic():
    r = np.random.default_rng(1)
    m = r.normal(size=(8, 5))
    h, g, w = m.T @ m, r.normal(size=5) * 3, r.normal(size=5)
    l1, l2 = np.array([0.0, 0.5, 1.0, 0.2, 4.0]), np.array([0.0, 0.1, 0.0, 0.3, 0.0])

    def value(v):
        d = v - w
        return g @ d + d @ h @ d / 2 + (l1 * np.abs(v)).sum() + (l2 * v * v).sum() / 2
    best = quadratic_step(w, g, h, l1, l2)
    for _ in range(300):
        assert value(best) <= value(best + r.normal(size=5) * 10.0 ** r.integers(-6, 1)) + 1e-12


def test_own_columns_nulls_and_test_rows(spark):
    x, y = drawn(90)
    df = frame(spark, x, y, test=4)
    model = fit_linear(df, [["a"], ["a", "b"], ["c"]], 0.0, 1.0)
    assert [len(w) for w in model.weights] == [2, 3, 2]
    got = predict_linear(df, model).collect()
    assert len(got) == 90 + 12
    want = 1 / (1 + np.exp(-(model.weights[1][0] + model.weights[1][1] * 1.0)))     # b is NULL: absent
    assert [r["pred"] for r in got if r["split"] == "test" and r["fold"] == 1] == pytest.approx([want] * 4)


def test_one_class_and_no_rows_end(spark):
    x, _ = drawn(30)
    df = frame(spark, x, np.ones(30, int))
    preds = predict_linear(df, fit_linear(df, [NAMES] * 3, 0.0, 1.0)).collect()
    assert len(preds) == 30 and min(r["pred"] for r in preds) > 0.9
    none = df.limit(0)
    assert predict_linear(none, fit_linear(none, [NAMES] * 3)).collect() == []


def test_penalties_follow_the_spec():
    assert mo.linear_penalties(mo.lookup("lr1")) == {"l2": 1 / 0.8, "l1": 0.0}
    assert mo.linear_penalties(mo.lookup("lr4")) == {"l1": 1.0, "l2": 0.0}
    assert mo.linear_penalties(mo.lookup("xgbl")) == {"l1": 0.0001, "l2": 2.0}
    with pytest.raises(ValueError):
        mo.linear_penalties(mo.ModelSpec("x", "lr", {"invented": 1}))


def test_bags_without_a_draw_share_the_fit(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(oo, "fit_linear", lambda *a, **k: calls.append(1) or fit_linear(*a, **k))
    x, y = drawn(60)
    preds = oo.oof_train(frame(spark, x, y), mo.lookup("lr1"), NAMES, k=3, bags=3)
    assert len(calls) == 1 and preds.count() == 180


def test_bags_on_shared_folds_are_predicted_once(spark, monkeypatch):
    # Nothing is drawn, so the bags are copies of one prediction; before, every bag scanned the rows again
    calls = []
    plain = oo.predict_linear
    monkeypatch.setattr(oo, "predict_linear", lambda *a, **k: calls.append(a) or plain(*a, **k))
    df = spark.createDataFrame([(i, "test" if i % 7 == 0 else "train", None if i % 7 == 0 else i % 5, None if i % 7 == 0 else i % 2,
                                 float(i * 37 % 11)) for i in range(140)], "id int, split string, fold int, target int, a double")
    out = oo.oof_train(df, mo.lookup("lr2"), ["a"], bags=3, splits=2).toPandas()
    assert len(calls) == 2 and len(out) == 2 * 3 * (120 + 5 * 20)
    for _, own in out.groupby(["rep", "split", "id", "fold"]):
        assert sorted(own["bag"]) == [0, 1, 2] and own["pred"].nunique() == 1
    assert dict(zip(out.columns, out.dtypes.astype(str)))["bag"] == "int32"


def test_rounds_read_blocks_of_rows(spark):
    # the rounds move blocks of bytes, not every number of every row; their sums are those of the rows
    from foldwise.plans import linear as ln
    rows = spark.range(50, numPartitions=3).select(
        (F.col("id") % 3).cast("int").alias("part"), (F.col("id") % 2).cast("double").alias("y"),
        (F.lit(1.0) + F.col("id") % 2).alias("w"), F.when(F.col("id") != 7, F.col("id") / 50).alias("x0"))
    packed = ln._packed(rows, 1)
    assert packed.agg(F.sum("n")).first()[0] == 50 and packed.count() < 50
    w = np.array([0.3, -0.7])
    found = ln._sums(packed, [[0], [0], [0]], {1: w}, 1)[1]
    own = rows.filter("part <> 1").fillna(0.0).toPandas()
    z = w[0] + w[1] * own["x0"]
    p = 1 / (1 + np.exp(-z))
    assert found[0] == pytest.approx((own["w"] * (np.log1p(np.exp(z)) - own["y"] * z)).sum(), rel=1e-12)
    assert found[1] == pytest.approx([(own["w"] * (p - own["y"])).sum(), (own["w"] * (p - own["y"]) * own["x0"]).sum()], rel=1e-12)
    assert [b[0, 0] for b in found[2]] == pytest.approx([(own["w"] * p * (1 - p)).sum(), (own["w"] * p * (1 - p) * own["x0"] ** 2).sum()], rel=1e-12)
