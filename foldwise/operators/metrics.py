"""Exact, tie-aware normalised Gini (2*AUC - 1) and CV score reports.

Rows are first aggregated to one row per distinct score (per group), which
absorbs ties and hot scores; negatives below each score come from
``running_sums`` (bucketed, broadcast offsets), never a single-partition
window.  Everything is DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ordered import BUCKET_ROWS, running_sums
from foldwise.session import default_buckets, materialize


def gini(df: DataFrame, label: str = "target", score: str = "pred", by: list[str] | tuple = (),
         out: str = "gini", buckets: int | None = None) -> DataFrame:
    by = list(by)
    y = F.col(label).cast("double")
    g = (df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
           .groupBy(*by, score).agg(F.sum(y).alias("_pos"), F.sum(F.lit(1.0) - y).alias("_neg")))
    r = running_sums(g, by, [score], ["_neg"], buckets)
    auc_num = F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2.0))
    # a group with one class has no Gini: NULL, and the other groups go on
    val = F.try_divide(F.lit(2.0) * auc_num, F.sum("_pos") * F.sum("_neg")) - F.lit(1.0)
    return r.groupBy(*by).agg(val.alias(out))


def cv_summary(preds: DataFrame, label_df: DataFrame, by: list[str] = ("model", "bag"),
               id_col: str = "id", label: str = "target", score: str = "pred",
               fold_col: str = "fold") -> DataFrame:
    """Per ``by`` group the Gini of each fold, their mean and population std over the
    ``folds`` that have one, and the Gini of the whole out-of-fold prediction.

    Each OOF row is tagged twice, with its fold and with -1 ("all folds"), so
    per-fold and overall Gini come from one ordered pass.  The OOF rows are stored and counted: above the
    shuffle partitions' worth of rows (``BUCKET_ROWS`` each) join and aggregate get as many partitions as
    the rows need, so a task's memory does not follow the table.  Equal scores of one group meet in one
    task, as a stream into one entry."""
    by = list(by)
    oof = materialize(preds.filter(F.col("split") == "train").select(id_col, *by, fold_col, score), "oof")
    labels = label_df.select(id_col, label)
    n = -(-oof.count() // BUCKET_ROWS)
    if n > default_buckets(oof.sparkSession):
        oof = oof.repartition(n, id_col).join(labels.repartition(n, id_col), id_col).repartition(n, *by, score)
    else:
        oof = oof.join(labels, id_col)
    tagged = oof.withColumn("_g", F.explode(F.array(F.col(fold_col).cast("int"), F.lit(-1))))
    g = gini(tagged, label, score, by + ["_g"], "g")
    of_fold = F.when(F.col("_g") >= 0, F.col("g"))
    return g.groupBy(*by).agg(F.avg(of_fold).alias("mean_gini"), F.stddev_pop(of_fold).alias("std_gini"),
                              F.max(F.when(F.col("_g") == -1, F.col("g"))).alias("full_gini"),
                              F.count(of_fold).alias("folds"))
