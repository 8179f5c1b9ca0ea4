"""Scaling and imputation fitted as one-row statistics.

The statistics row is computed on the ``fit`` frame (which rows may be seen is
the caller's explicit choice) in one aggregate; its few numbers are column-level
statistics, brought to the driver and applied as literals, so the apply step
is a plain projection with no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats_row(fit: DataFrame, aggs: list) -> dict:
    """Evaluate one row of column statistics; returns ``{name: value}``."""
    return fit.agg(*aggs).collect()[0].asDict()


def stat_lit(v) -> F.Column:
    return F.lit(v).cast("double")


def _apply(df: DataFrame, stats: dict, exprs) -> DataFrame:
    ex = exprs(lambda name: stat_lit(stats[name]))
    return df.select(*[ex[c].alias(c) if c in ex else F.col(c) for c in df.columns])


def standard_scale(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None,
                   digits: int | None = 6) -> DataFrame:
    """``(x - mean) / std_pop`` (numpy/sklearn convention), rounded half-even."""
    fit = fit if fit is not None else df
    stats = stats_row(fit, [F.avg(c).alias(f"_mu_{c}") for c in cols] +
                      [F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])

    def exprs(v):
        out = {}
        for c in cols:
            sd = v(f"_sd_{c}")
            z = (F.col(c) - v(f"_mu_{c}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
            out[c] = F.bround(z, digits) if digits is not None else z
        return out
    return _apply(df, stats, exprs)


def scale_no_center(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """``x / std_pop`` (``with_mean=False``)."""
    fit = fit if fit is not None else df
    stats = stats_row(fit, [F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    return _apply(df, stats, lambda v: {c: F.col(c) / F.when(v(f"_sd_{c}") == 0, F.lit(1.0))
                                        .otherwise(v(f"_sd_{c}")) for c in cols})


def minmax_scale(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """``(x - min) / (max - min)`` with bounds from ``fit``."""
    fit = fit if fit is not None else df
    stats = stats_row(fit, [F.min(c).cast("double").alias(f"_lo_{c}") for c in cols] +
                      [F.max(c).cast("double").alias(f"_hi_{c}") for c in cols])

    def exprs(v):
        out = {}
        for c in cols:
            span = v(f"_hi_{c}") - v(f"_lo_{c}")
            out[c] = F.when(span > 0, (F.col(c) - v(f"_lo_{c}")) / span).otherwise(F.lit(0.0))
        return out
    return _apply(df, stats, exprs)


def impute_mean(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """NULL -> mean of ``fit`` (train means are used for test rows too)."""
    fit = fit if fit is not None else df
    stats = stats_row(fit, [F.avg(c).alias(f"_mu_{c}") for c in cols])
    return _apply(df, stats, lambda v: {c: F.coalesce(F.col(c).cast("double"), v(f"_mu_{c}")) for c in cols})


def fold_apply(df: DataFrame, k: int, fit: Callable[[DataFrame], object], apply: Callable[[DataFrame, object], DataFrame],
               fold_col: str = "fold", out_fold: str = "model_fold") -> DataFrame:
    """X6 for any statistic: per fold model j, ``fit`` sees the labelled rows with ``fold != j`` and
    ``apply`` maps all labelled rows (tagged ``part`` train/valid) with what it returned.  Statistics
    that add up over folds need only one pass (``fold_minmax_scale``)."""
    lab = df.filter(F.col(fold_col).isNotNull())
    parts = []
    for j in range(k):
        part = F.when(F.col(fold_col) == j, F.lit("valid")).otherwise(F.lit("train"))
        rows = lab.withColumn(out_fold, F.lit(j).cast("int")).withColumn("part", part)
        parts.append(apply(rows, fit(lab.filter(F.col(fold_col) != j))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_minmax_scale(df: DataFrame, cols: Sequence[str], k: int, fold_col: str = "fold",
                      out_fold: str = "model_fold") -> DataFrame:
    """X6 for a decomposable statistic: for every fold model j, min-max bounds
    fitted on labelled rows with ``fold != j`` and applied to all of them.

    Per-fold minima/maxima come from one aggregate (k rows); bounds "without
    fold j" are the min/max over the other folds, applied as literal arrays
    indexed by the fold model.  No per-fold rescans, no join.
    """
    lab = df.filter(F.col(fold_col).isNotNull())
    per = {r[fold_col]: r for r in lab.groupBy(fold_col).agg(
        *[F.min(c).cast("double").alias(f"_lo_{c}") for c in cols],
        *[F.max(c).cast("double").alias(f"_hi_{c}") for c in cols]).collect()}     # k rows
    rows = lab.withColumn(out_fold, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    scaled = []
    for c in cols:
        lo = [min((per[f][f"_lo_{c}"] for f in per if f != j and per[f][f"_lo_{c}"] is not None), default=None)
              for j in range(k)]
        hi = [max((per[f][f"_hi_{c}"] for f in per if f != j and per[f][f"_hi_{c}"] is not None), default=None)
              for j in range(k)]
        lo_c = F.element_at(F.array(*[stat_lit(v) for v in lo]), F.col(out_fold) + 1)
        hi_c = F.element_at(F.array(*[stat_lit(v) for v in hi]), F.col(out_fold) + 1)
        span = hi_c - lo_c
        scaled.append(F.when(span > 0, (F.col(c) - lo_c) / span).otherwise(F.lit(0.0)).alias(c))
    part = F.when(F.col(fold_col) == F.col(out_fold), F.lit("valid")).otherwise(F.lit("train")).alias("part")
    keep = [c for c in df.columns if c not in cols]
    return rows.select(*keep, out_fold, part, *scaled)
