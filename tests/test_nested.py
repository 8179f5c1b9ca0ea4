"""Nested encodings: definition, leaks, plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import nested as ne
from foldwise.operators.nested import fit_nested_encoding, target_encode_nested
from foldwise.plans import models as mo
from foldwise.plans import oof as oo

ROWS = [(i, "train" if i < 60 else "test", i % 3 if i < 60 else None, int(i * 7 % 11 < 5) if i < 60 else None,
         None if i % 13 == 0 else i % 4, f"u{i}") for i in range(70)]
SCHEMA = "id long, split string, fold int, target int, c int, u string"


def by_hand(rows, col, i, j, value, msl=2, smooth=3):
    use = [r for r in rows if r[2] is not None and r[2] not in (i, j)]
    prior = sum(r[3] for r in use) / len(use)
    own = [r[3] for r in use if r[col] is not None and r[col] == value]
    if not own:
        return prior
    w = 1 / (1 + np.exp(-(len(own) - msl) / smooth))
    return prior * (1 - w) + sum(own) / len(own) * w


def test_every_row_of_every_model(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = target_encode_nested(df, ["c", "u"], k=3, min_samples_leaf=2, smoothing=3).collect()
    assert len(got) == 70 * 3
    for r in got:
        j = r["model_fold"]
        i = j if r["fold"] is None else r["fold"]
        assert r["part"] == ("test" if r["fold"] is None else "valid" if i == j else "train")
        assert r["c_avg"] == pytest.approx(by_hand(ROWS, 4, i, j, r["c"]))
        assert r["u_avg"] == pytest.approx(by_hand(ROWS, 5, i, j, r["u"]))     # every value once: always the prior


def test_own_label_has_no_effect(spark):
    flipped = [(*r[:3], 1 - r[3] if r[0] == 17 else r[3], *r[4:]) for r in ROWS]

    def of(rows):
        enc = target_encode_nested(spark.createDataFrame(rows, SCHEMA), ["c"], k=3, min_samples_leaf=2, smoothing=3)
        return {r["model_fold"]: r["c_avg"] for r in enc.filter("id = 17").collect()}
    assert of(ROWS) == of(flipped)


def test_one_aggregate_fits_all_pairs(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ne, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    fit_nested_encoding(spark.createDataFrame(ROWS, SCHEMA), ["c", "u"], k=3)
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1


def test_a_column_of_noise_gains_nothing_in_training(spark):
    """Many rare values: plain out-of-fold encodings of the train rows hold their labels, nested ones do not."""
    r = np.random.default_rng(4)
    rows = [(i, "train", int(i % 4), int(r.random() < 0.5), int(r.integers(0, 400)), "") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    spec = mo.ModelSpec("x", "linear", {"lambda": 0.0})

    def train_gain(nested):
        """Objective of fold model 0 on its encoded train rows against no input at all."""
        seen = []
        real = oo.fit_linear
        try:
            oo.fit_linear = lambda *a, **k: seen.append(real(*a, **k)) or seen[-1]
            oo.oof_train(df, spec, [], k=4, te_cols=["c"], te_params=(1, 1), nested=nested)
        finally:
            oo.fit_linear = real
        return 1500 * np.log(2) - seen[0].objective[0]
    assert train_gain(False) > 60 and train_gain(True) < 12


def test_no_labelled_rows_raise(spark):
    with pytest.raises(ValueError):
        fit_nested_encoding(spark.createDataFrame(ROWS, SCHEMA).filter(F.col("fold").isNull()), ["c"], k=3)
