"""Parameter sweep: one Gini pass for all folds and points, same values as a loop over them."""

import pytest

from foldwise.operators.metrics import gini
from foldwise.plans import sweep as sw


def _rows(spark, n=400, classes=True):
    return spark.createDataFrame(
        [(i, i % 5 if i % 11 else None, int((i * 7919 % 101) + 20 * (i % 3) > 70) if classes or i % 5 else 0,
          float(i * 7919 % 101), float(i % 3) if i % 13 else None) for i in range(n)],
        "id int, fold int, target int, a double, b double").fillna(0.5, ["b"])


def _lr():
    from pyspark.ml.classification import LogisticRegression
    return LogisticRegression(maxIter=20)


POINTS = [{"regParam": 0.01, "elasticNetParam": 0.0}, {"regParam": 0.2, "elasticNetParam": 1.0}]


def test_sweep_scores_all_points_in_one_pass(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    calls = []

    def counted(*args, **kw):
        calls.append(args[0].rdd.getNumPartitions())
        return gini(*args, **kw)

    monkeypatch.setattr(sw, "gini", counted)
    df = _rows(spark).coalesce(1)
    got = {r["point"]: r["mean_gini"] for r in sw.param_sweep(df, _lr(), POINTS, ["a", "b"]).collect()}
    assert len(calls) == 1 and calls[0] > 1                 # one pass over rows dealt over the cores
    asm = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    lab = asm.transform(df.filter("fold IS NOT NULL"))
    for i, p in enumerate(POINTS):
        each = []
        for j in range(5):
            est = _lr().setFeaturesCol("features").setLabelCol("target").setParams(**p)
            held = est.fit(lab.filter(f"fold <> {j}")).transform(lab.filter(f"fold = {j}"))
            held = held.select("target", vector_to_array("probability")[1].alias("pred"))
            each.append(gini(held).collect()[0]["gini"])
        assert got[i] == pytest.approx(sum(each) / 5, abs=1e-9)


def test_sweep_of_a_fold_with_one_class_is_minus_infinity(spark):
    got = sw.param_sweep(_rows(spark, classes=False), _lr(), POINTS, ["a", "b"]).collect()
    assert [r["mean_gini"] for r in got] == [float("-inf")] * 2


def test_sweep_refuses_empty_and_foreign_folds(spark):
    with pytest.raises(ValueError):
        sw.param_sweep(_rows(spark).filter("fold <> 3"), _lr(), POINTS, ["a", "b"])
    with pytest.raises(ValueError):
        sw.param_sweep(_rows(spark), _lr(), POINTS, ["a", "b"], k=4)
