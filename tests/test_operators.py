"""Operator tests: fold-wise preprocessing, derived features, gates, sinks, stacking."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from foldwise.operators import encode as en
from foldwise.operators import express as ex
from foldwise.operators import scale as sc
from foldwise.sources import fixtures as fx


def test_fold_minmax_matches_naive_loop(spark):
    df = fx.policy_folds(spark, SF_SMALL).select("id", "fold", "price")
    got = {(r["id"], r["model_fold"]): r["price"] for r in sc.fold_minmax_scale(df, ["price"], 5).collect()}
    rows = [r for r in df.collect() if r["fold"] is not None]
    for j in range(5):
        fit = [r["price"] for r in rows if r["fold"] != j]
        lo, hi = min(fit), max(fit)
        for r in rows:
            assert got[(r["id"], j)] == pytest.approx((r["price"] - lo) / (hi - lo))


def test_standard_scale_uses_population_std(spark):
    import numpy as np
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "id long, x double")
    got = [r["x"] for r in sc.standard_scale(df, ["x"], digits=None).orderBy("id").collect()]
    v = np.array([1.0, 2.0, 4.0])
    assert got == pytest.approx(list((v - v.mean()) / v.std()))


def test_derive_levels_and_values(spark):
    levels = ex.dependency_levels(ex.NONLINEAR_FORMULAS)
    assert len(levels) == 4 and "v017" in levels[3]
    df = spark.createDataFrame([(1, 0.5)], "id long, a double")
    out = ex.derive(df, {"b": "a * 2", "c": "b + a", "d": "pow(c, 2)"}).collect()[0]
    assert (out["b"], out["c"], out["d"]) == (1.0, 1.5, 2.25)
    with pytest.raises(ValueError):
        ex.dependency_levels({"x": "y + 1", "y": "x + 1"})


def test_ensemble_is_mean_of_sigmoids(spark):
    import math
    df = spark.createDataFrame([(1, 0.3)], "id long, a double")
    sets = [([("t0", 0.5, "a"), ("t1", 0.25, "a * 2")], -0.1), ([("t0", 1.0, "a")], 0.2)]
    got = ex.expression_ensemble(df, sets).collect()[0]["score"]
    s1 = 0.5 * math.tanh(0.3) + 0.25 * math.tanh(0.6) - 0.1
    s2 = math.tanh(0.3) + 0.2
    want = (1 / (1 + math.exp(-s1)) + 1 / (1 + math.exp(-s2))) / 2
    assert got == pytest.approx(want)


def test_lowcard_gate_counts_null_as_a_value(spark):
    rows = [(1, 0), (2, 1), (3, None), (4, 0)]       # {0, 1, NULL}: 3 values -> gated in
    df = spark.createDataFrame(rows, "id long, c int")
    out = en.one_hot_lowcard(df, ["c"], fit=df)
    assert sorted(c for c in out.columns if "_oh_" in c) == ["c_oh_0", "c_oh_1"]
    assert {r["id"]: (r["c_oh_0"], r["c_oh_1"]) for r in out.collect()}[3] == (0, 0)
    two = en.one_hot_lowcard(df.filter("c IS NOT NULL"), ["c"], fit=df.filter("c IS NOT NULL"))
    assert not [c for c in two.columns if "_oh_" in c]


def test_persisted_features_prune_partitions(spark):
    from foldwise.sources.features import persist_features, read_features
    df = fx.policy(spark, SF_SMALL).select("id", "price", "split")
    path = persist_features(df)
    back = read_features(spark, path, "test")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split#" in plan
    assert back.count() == df.filter("split = 'test'").count()


def test_stack_two_levels_run(spark):
    from foldwise.plans import models as mo
    from foldwise.plans import stack as sk
    preds = fx.scores(spark, SF_SMALL)
    labels = fx.policy(spark, SF_SMALL).select("id", "target")
    models = list(fx.SCORE_MODELS)
    l2 = sk.stack_level(preds, labels, models, mo.lookup("stack_lr1"))
    l3 = sk.stack_level(l2.unionByName(sk.stack_level(preds, labels, models, mo.lookup("xgbl"))),
                        labels, ["stack_lr1", "xgbl"], mo.lookup("stack_lr2"))
    n_train = labels.join(preds.select("id").distinct(), "id").filter("target IS NOT NULL").count()
    assert l3.filter("split = 'train'").count() == n_train
    assert l3.filter("pred < 0 OR pred > 1").count() == 0


def test_rbf_features_match_numpy(spark):
    import numpy as np
    from foldwise.operators import cluster as cl
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 4.0])], "id long, v array<float>")
    centers = [(0, [0.0, 0.0]), (1, [3.0, 0.0])]
    got = {r["id"]: (r["rbf_0"], r["rbf_1"]) for r in cl.rbf_features(df, "v", centers, 0.5, keep=["id"]).collect()}
    for i, v in [(1, [0.0, 1.0]), (2, [3.0, 4.0])]:
        want = tuple(float(np.exp(-0.5 * np.linalg.norm(np.array(v) - np.array(c)))) for _, c in centers)
        assert got[i] == pytest.approx(want)


def test_csv_scan_with_sentinel_and_expected_rows(spark):
    from pyspark.sql import types as T

    from foldwise.session import scratch_path
    from foldwise.sources.scan import read_frame, read_labelled
    path = scratch_path(spark, "csv-fixture")
    src = fx.policy(spark, SF_SMALL, sentinel_null=False).select("id", "target", "split", "age", "bal")
    src.drop("split").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("target", T.IntegerType()),
                           T.StructField("age", T.IntegerType()), T.StructField("bal", T.DoubleType())])
    df = read_frame(spark, path, schema, fmt="csv", sentinel="-1")
    n_sent = src.filter("age = -1").count()
    assert df.filter("age IS NULL").count() == n_sent and df.filter("age = -1").count() == 0
    assert df.filter("bal IS NULL").count() == src.filter("bal = -1").count() > 0
    train = df.filter(F.col("id") % 5 != 0)
    test = df.filter(F.col("id") % 5 == 0).drop("target")
    both = read_labelled(train, test, expect=(train.count(), test.count()))
    assert both.filter("split = 'test' AND target IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        read_labelled(train, test, expect=(1, 1))
    with pytest.raises(ValueError):
        read_frame(spark, path, None, fmt="csv")


def test_tables_are_read_through_spark_only(spark, tmp_path):
    from foldwise.sources.tables import read_table
    spark.range(5).write.parquet(str(tmp_path / "region.parquet"))       # a folder works like a file
    assert read_table(spark, str(tmp_path), "region").count() == 5
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "unknown")


def test_expression_terms_are_evaluated_once_on_all_cores(spark):
    """Equal expressions share one tanh, and a table of one split is dealt over all cores."""
    df = spark.createDataFrame([(1, 0.5, 2.0), (2, None, 1.0), (2, None, 1.0)], "id long, a double, b double").coalesce(1)
    one = [("t0", 0.5, "a + b"), ("t1", 0.25, "a + b"), ("t2", 2.0, "b")]
    two = [("t2", 1.0, "a + b"), ("t1", 3.0, "b"), ("t0", 4.0, "b")]
    for out, distinct in ((ex.expression_features(df, one), 2), (ex.expression_features_sum(df, one, two), 2)):
        assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("tanh(") == distinct
    t = lambda x: None if x is None else math.tanh(x)
    w = lambda x, y: None if y is None else x * y
    got = sorted(map(tuple, ex.expression_features(df, one).collect()))
    assert got[0] == pytest.approx((1, 0.5 * t(2.5), 0.25 * t(2.5), 2.0 * t(2.0)))
    assert got[1] == got[2] and got[1][:3] == (2, None, None) and got[1][3] == pytest.approx(2.0 * t(1.0))
    first = min(map(tuple, ex.expression_features_sum(df, one, two).collect()))
    assert first == pytest.approx((1, 0.5 * t(2.5) + 4.0 * t(2.0), 0.25 * t(2.5) + 3.0 * t(2.0), 2.0 * t(2.0) + t(2.5)))


def test_rounding_is_half_away_from_zero_on_the_product(spark):
    from foldwise.registry import round_half_away
    vals = [0.5e-6, -0.5e-6, 1.5e-6, 2.5e-6, -2.5e-6, 0.49999999999999994e-6, -1e-9, 3.0000005, 1e300, float("inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = [r["y"] for r in df.select("i", round_half_away(F.col("x")).alias("y")).orderBy("i").collect()]
    c_round = lambda v: v if abs(v) >= 2.0 ** 52 else math.copysign(math.floor(abs(v)) + (abs(v) - math.floor(abs(v)) >= 0.5), v)
    assert list(map(repr, got)) == [repr(None if v is None else c_round(v * 1e6) / 1e6) for v in vals]


def test_expression_rows_are_dealt_by_the_join_alone(spark, tmp_path):
    """Before, the rows were shuffled for the join and once more to deal them; a crowded customer still takes a second one."""
    import datetime

    from foldwise.queries_features import q_expr_features, q_expr_features_sum
    from foldwise.sources import fixtures as fx
    day = datetime.datetime(1995, 3, 1)
    customers = [(k, k % 25, "BUILDING", 100.0 * k - 500) for k in range(40)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double") \
        .write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(i, None if i % 50 == 0 else i % 45, "OF"[i % 2], 1000.0 + i, day, f"{i % 5 + 1}-X") for i in range(400)] * 2
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                  "o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(fx.policy(spark, str(tmp_path)))
    assert len(want) == sum(1 for o in orders if o[1] is not None and o[1] < 40)
    assert plain(fx.policy(spark, str(tmp_path), dealt=True)) == want
    for query in (q_expr_features, q_expr_features_sum):
        df = query(spark, str(tmp_path))
        assert "RoundRobin" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows, fx.TASK_ROWS = fx.TASK_ROWS, 10
    try:
        crowded = fx.policy(spark, str(tmp_path), dealt=True)
    finally:
        fx.TASK_ROWS = rows
    assert "RoundRobin" in crowded._jdf.queryExecution().executedPlan().toString() and plain(crowded) == want
