"""Prediction tables.

One long table ``(id, model, split, fold, bag, pred)`` replaces the
reference's file pairs.  Written runs are partitioned by a ``run`` name that
carries the scores in the reference's ``date-model-mean-full-std`` format, so
the file names stay informative and partition discovery restores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.session import scratch_path

_SCORE = r"(-?\d+\.\d{5}|null)"          # an undefined Gini is written as null
RUN_PATTERN = rf"^(\d{{8}}-\d{{4}})-(.+?)-{_SCORE}-{_SCORE}-{_SCORE}$"


def final_predictions(preds: DataFrame) -> DataFrame:
    """One prediction per (id, model, split): OOF averaged over bags,
    test averaged over fold models and bags (mean over existing rows; N2/N11)."""
    return preds.groupBy("id", "model", "split").agg(F.avg("pred").alias("pred"))


def run_names(summary: DataFrame, stamp: str) -> DataFrame:
    """``(model, run)`` with run = stamp-model-mean-full-std (5 decimals)."""
    name = F.format_string("%s-%s-%.5f-%.5f-%.5f", F.lit(stamp), F.col("model"),
                           F.col("mean_gini"), F.col("full_gini"), F.col("std_gini"))
    return summary.select("model", name.alias("run"))


def write_predictions(preds: DataFrame, summary: DataFrame, stamp: str, path: str | None = None) -> str:
    """Final predictions partitioned by (run, split); scores in the run name.
    The run table has one row per model (counted before it is broadcast)."""
    from foldwise.operators.joins import join_stats
    path = path or scratch_path(preds.sparkSession, "predictions")
    runs = run_names(summary, stamp)
    join_stats(final_predictions(preds), runs, "model", "inner", n_stats=runs.count()) \
        .select("id", "pred", "run", "split") \
        .write.partitionBy("run", "split").parquet(path)
    return path


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Every run and split in one scan; ``run``/``split`` come from the folders."""
    return spark.read.parquet(path)


def parse_run_names(df: DataFrame, col: str = "run") -> DataFrame:
    """Split run names into stamp, model and the three scores.  A name of another
    form, or an undefined score, gives NULL scores."""
    c = F.col(col)
    return df.select(
        "*",
        F.regexp_extract(c, RUN_PATTERN, 1).alias("stamp"),
        F.regexp_extract(c, RUN_PATTERN, 2).alias("model"),
        F.regexp_extract(c, RUN_PATTERN, 3).try_cast("double").alias("mean_gini"),
        F.regexp_extract(c, RUN_PATTERN, 4).try_cast("double").alias("full_gini"),
        F.regexp_extract(c, RUN_PATTERN, 5).try_cast("double").alias("std_gini"))


def stack_matrix(preds: DataFrame, models: list[str], split: str = "train") -> DataFrame:
    """One row per id, one column per model (names listed, so the
    pivot needs no extra distinct job).  A model missing for an id is NULL here;
    ``plans.stack.check_complete`` turns that into an error (N7)."""
    final = final_predictions(preds.filter(F.col("split") == split))
    wide = final.groupBy("id").pivot("model", models).agg(F.first("pred"))
    return wide
