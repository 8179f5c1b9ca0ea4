"""Property tests against brute force."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwise.operators import metrics as me
from foldwise.operators import target as te


def _brute_gini(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    return 2 * auc - 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6).map(lambda v: v / 4.0)), min_size=4, max_size=40)
       .filter(lambda r: 0 < sum(y for y, _ in r) < len(r)))
def test_gini_equals_pair_count(spark, rows):
    df = spark.createDataFrame(rows, "y int, p double")
    got = me.gini(df, "y", "p", buckets=3).collect()[0]["gini"]
    assert got == pytest.approx(_brute_gini(rows))


def test_gini_matches_mllib_exact_auc(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    df = spark.range(4000).select(
        (F.pmod(F.col("id") * 7919, F.lit(13)) < 5).cast("double").alias("y"),
        (F.pmod(F.col("id") * 104729, F.lit(997)) / 997.0 + F.pmod(F.col("id") * 7919, F.lit(13)) / 40.0).alias("p"))
    ours = me.gini(df, "y", "p").collect()[0]["gini"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", metricName="areaUnderROC", numBins=0)
    assert ours == pytest.approx(2 * ev.evaluate(df) - 1, abs=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 1), st.integers(0, 2)),
                min_size=6, max_size=30))
def test_oof_encoding_equals_naive(spark, rows):
    import math
    data = [(i, c, y, f) for i, (c, y, f) in enumerate(rows)]
    if len({f for *_, f in data}) < 3:
        return
    df = spark.createDataFrame(data, "id long, c string, target int, fold int")
    got = {r["id"]: r["c_avg"] for r in te.target_encode_oof(df, ["c"], k=3, min_samples_leaf=2, smoothing=1.5).collect()}
    for i, c, y, f in data:
        others = [(c2, y2) for _, c2, y2, f2 in data if f2 != f]
        prior = sum(y2 for _, y2 in others) / len(others)
        same = [y2 for c2, y2 in others if c is not None and c2 == c]
        if same:
            w = 1 / (1 + math.exp(-(len(same) - 2) / 1.5))
            want = prior * (1 - w) + sum(same) / len(same) * w
        else:
            want = prior
        assert got[i] == pytest.approx(want)


def test_cv_summary_partitions_follow_the_rows(spark, monkeypatch):
    """Above the shuffle partitions' worth of rows the aggregate that feeds the ordered pass is dealt into more parts."""
    from foldwise.operators import metrics as me
    seen = []
    real = me.running_sums

    def spy(df, *args):
        seen.append(df.rdd.getNumPartitions())
        return real(df, *args)

    rows = [(i, "ab"[m], m % 2, "train" if i % 5 else "test", i % 3, None if i % 50 == 1 else round((i * 37 % 101) / 90, 2) + m / 4)
            for i in range(400) for m in range(2)]
    preds = spark.createDataFrame(rows + rows[10:14], "id long, model string, bag int, split string, fold int, pred double")
    labels = spark.createDataFrame([(None if i == 7 else i, None if i == 9 else i * i % 7 % 2) for i in range(400)], "id long, target int")
    want = sorted(map(str, me.cv_summary(preds, labels).collect()))
    monkeypatch.setattr(me, "running_sums", spy)
    monkeypatch.setattr(me, "BUCKET_ROWS", 20)
    got = sorted(map(str, me.cv_summary(preds, labels).collect()))
    assert seen == [33]                  # 640 + 4 rows with a fold, 20 in a part
    assert got == want and len(got) == 2
