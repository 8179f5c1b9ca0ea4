"""Splits, folds, resampling and seed schedules.

Folds are hash draws of the id: deterministic, computed per row with no sort
and no shuffle, identical in DuckDB.  The stratified variant numbers rows per
class in md5 order; numbering runs inside md5-prefix buckets with broadcast
offsets (65536*classes rows at most), never in one global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.hashing import hash_mod
from foldwise.operators.joins import join_stats
from foldwise.session import materialize


def kfold(df: DataFrame, k: int = 5, seed: int = 1024, id_col: str = "id",
          split_col: str | None = "split", out: str = "fold") -> DataFrame:
    """Shuffled k-fold; only labelled (train) rows get a fold."""
    fold = hash_mod(seed, id_col, k).cast("int")
    if split_col:
        fold = F.when(F.col(split_col) == "train", fold)
    return df.withColumn(out, fold)


def kfold_stratified(df: DataFrame, k: int = 5, seed: int = 1024, label: str = "target",
                     id_col: str = "id", out: str = "fold", prefix_hex: int = 4) -> DataFrame:
    """Per class, rows ordered by (md5(seed:id), id) are dealt round robin to k folds.

    Equal to ``row_number() OVER (PARTITION BY label ORDER BY md5, id) - 1 mod k``
    but numbered inside ``16**prefix_hex`` md5-prefix buckets per class (offsets: 2*16**prefix_hex rows).
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    lab = df.filter(F.col(label).isNotNull()).withColumn("_h", h) \
        .withColumn("_b", F.substring("_h", 1, prefix_hex))
    # at most classes x 16**prefix_hex rows, stored: they are counted and joined
    counts = materialize(lab.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n")), "fold-counts")
    w_off = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(label, "_b", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    w = Window.partitionBy(label, "_b").orderBy("_h", id_col)
    n_off = counts.count()          # classes x 16**prefix_hex at most
    numbered = join_stats(lab, offsets, [label, "_b"], "inner", n_stats=n_off) \
        .withColumn(out, F.pmod(F.col("_off") + F.row_number().over(w) - 1, F.lit(k)).cast("int")) \
        .drop("_h", "_b", "_off")
    unlabelled = df.filter(F.col(label).isNull()).withColumn(out, F.lit(None).cast("int"))
    return numbered.unionByName(unlabelled)


def kfold_repeated(df: DataFrame, n_splits: int = 3, k: int = 5, seed: int = 1024,
                   id_col: str = "id", split_col: str | None = "split") -> DataFrame:
    """``n_splits`` independent fold draws; split r uses seed + 11*r (long form)."""
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    seed_col = (F.lit(seed) + F.col("rep") * 11).cast("string")
    key = F.concat(seed_col, F.lit(":"), F.col(id_col).cast("string"))
    fold = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int")
    if split_col:
        fold = F.when(F.col(split_col) == "train", fold)
    return out.withColumn("fold", fold)


def fold_slices(df: DataFrame, k: int, fold_col: str = "fold") -> DataFrame:
    """Every row once per fold model, tagged 'train' (fold != j) or 'valid' (fold == j)."""
    lab = df.filter(F.col(fold_col).isNotNull())
    return lab.withColumn("model_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) \
        .withColumn("part", F.when(F.col(fold_col) == F.col("model_fold"), "valid").otherwise("train"))


def seed_schedule(seed, split=0, fold=0, bag=0):
    """Learner seed for (split, fold, bag); accepts ints or Columns."""
    return seed + split * 11 + fold * 17 + bag * 13


def upsample_positive(df: DataFrame, label: str = "target", split_col: str = "split",
                      copy_col: str = "copy") -> DataFrame:
    """Append one copy of every positive *train* row (no shuffle needed)."""
    extra = df.filter((F.col(split_col) == "train") & (F.col(label) == 1))
    return df.withColumn(copy_col, F.lit(0)).unionByName(extra.withColumn(copy_col, F.lit(1)))


def union_split(train: DataFrame, test: DataFrame, label: str = "target") -> DataFrame:
    """One frame with a ``split`` column; test gets a NULL label, never 0."""
    if label not in test.columns:
        test = test.withColumn(label, F.lit(None).cast(train.schema[label].dataType))
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
