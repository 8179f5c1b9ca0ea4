"""Nested out-of-fold target encoding.

Out-of-fold encoding keeps a row's label out of the model that scores it, but the train rows of
fold model j are still encoded with statistics that hold their own labels.  Here a row of fold i is
encoded, for model j, without folds i and j.  The single aggregate of ``category_stats`` has the sums of every
fold, so "total minus fold i minus fold j" needs no further pass: a value carries a k x k array, and rows pick
element (i, j).  Held-out rows (i = j) and unlabelled rows take (j, j).  Priors are per pair too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.target import TOTAL, TargetEncoding, category_stats, smoothed
from foldwise.session import materialize


def fit_nested_encoding(df: DataFrame, cols: list[str], label: str = "target", fold_col: str = "fold", k: int = 5,
                        min_samples_leaf: float = 200, smoothing: float = 10) -> TargetEncoding:
    """A ``TargetEncoding`` whose ``enc`` has k * k elements, the one without folds i and j at i * k + j."""
    raw = materialize(category_stats(df, cols, label, fold_col, k, with_total=True), "nested-stats")
    sizes = raw.groupBy("col").agg(F.count(F.lit(1)).alias("values"), *[F.sum(c).alias(c) for c in raw.columns[2:]]).collect()
    totals = next((r for r in sizes if r["col"] == TOTAL), None)
    if totals is None:
        raise ValueError("no labelled rows to fit target statistics on")
    pairs = [(i, j) for i in range(k) for j in range(k)]

    def without(row, name: str, i: int, j: int):
        """Sum without folds i and j, from a row or as an expression."""
        get = (lambda c: F.col(c)) if row is None else row.__getitem__
        return get(name) - get(f"{name}_{i}") - (get(f"{name}_{j}") if i != j else 0)

    priors = []
    for i, j in pairs:
        n = without(totals, "n", i, j)
        priors.append(without(totals, "s", i, j) / n if n else None)

    def encoded(i: int, j: int) -> Column:
        n, s = (without(None, c, i, j).cast("double") for c in ("n", "s"))
        prior = F.lit(priors[i * k + j]).cast("double")
        return F.when(n > 0, smoothed(n, s, prior, min_samples_leaf, smoothing)).otherwise(prior)

    fitted = raw.filter(F.col("col") != TOTAL).select(
        "col", "value", F.array(*[encoded(i, j) for i, j in pairs]).alias("enc"), F.lit(None).cast("double").alias("enc_full"), "n")
    counts = {r["col"]: r["values"] for r in sizes if r["col"] != TOTAL}
    return TargetEncoding(fitted, list(cols), k * k, priors, totals["s"] / totals["n"], counts, "prior", totals["n"])


def nested_element(encoding: TargetEncoding, array: Column, k: int, fold: Column, model: Column | int) -> Column:
    """The encoding of a row of ``fold`` (NULL: unlabelled) for fold model ``model``."""
    model = F.lit(model) if isinstance(model, int) else model
    at = F.coalesce(fold, model) * k + model + 1
    return F.coalesce(F.element_at(array, at), F.element_at(F.array(*[F.lit(p) for p in encoding.priors]), at))


def target_encode_nested(df: DataFrame, cols: list[str], label: str = "target", fold_col: str = "fold", k: int = 5,
                         min_samples_leaf: float = 200, smoothing: float = 10, suffix: str = "_avg",
                         model_fold: str = "model_fold") -> DataFrame:
    """Every row once per fold model, with ``part`` (train, valid or test) and encodings without its own label."""
    encoding = fit_nested_encoding(df, cols, label, fold_col, k, min_samples_leaf, smoothing)
    rows = encoding.attach(df, F.col("enc")).withColumn(model_fold, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    fold, model = F.col(fold_col), F.col(model_fold)
    part = F.when(fold.isNull(), "test").when(fold == model, "valid").otherwise("train")
    return rows.select(*df.columns, model_fold, part.alias("part"),
                       *[nested_element(encoding, F.col(f"_enc_{c}"), k, fold, model).alias(c + suffix) for c in cols])
