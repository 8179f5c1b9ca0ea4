"""Column statistics in one pass over unpivoted columns.

Medians are exact and distributed: values are aggregated to ``(col, value,
count)`` (map-side combine absorbs hot values), cumulative counts come from
``running_sums``, and the middle value(s) are picked per column.  No column's
values are ever gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ordered import running_sums


def unpivot_numeric(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    slim = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return slim.unpivot(list(keep), list(cols), "col", "value")


def exact_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(col, median)``; pandas semantics: NULLs skipped, even count -> mean of middle two."""
    long = unpivot_numeric(df, cols).filter(F.col("value").isNotNull())
    counts = long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("cnt"))
    cum = running_sums(counts, ["col"], ["value"], ["cnt"], totals="n")
    lo = F.floor((F.col("n") - 1) / 2)
    hi = F.floor(F.col("n") / 2)

    def covers(r: Column) -> Column:
        return (F.col("cnt_before") <= r) & (r < F.col("cnt_before") + F.col("cnt"))

    picked = cum.filter(covers(lo) | covers(hi)).groupBy("col").agg(
        F.max(F.when(covers(lo), F.col("value"))).alias("v_lo"),
        F.max(F.when(covers(hi), F.col("value"))).alias("v_hi"))
    return picked.select("col", ((F.col("v_lo") + F.col("v_hi")) / 2.0).alias("median"))


def sample_skewness(x: Column) -> Column:
    """pandas ``skew``: bias-corrected, ``g1 * sqrt(n(n-1))/(n-2)``."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2))


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column with n, mean, median, skew, min, max, std_pop.

    The moments are one aggregate over the columns (rows are not multiplied); its single
    row is turned into one row per column."""
    def entry(i: int, c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("col"), F.count(x).alias("n"), F.avg(x).alias("mean"),
                        sample_skewness(x).alias("skew"), F.min(x).alias("min"), F.max(x).alias("max"),
                        F.stddev_pop(x).alias("std_pop")).alias(f"_{i}")

    row = df.agg(*[entry(i, c) for i, c in enumerate(cols)])
    moments = row.select(F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))
    return moments.join(exact_medians(df, cols), "col", "left")


def column_distincts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(col, n_distinct, has_null)`` for all columns from one unpivot."""
    slim = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = slim.unpivot([], list(cols), "col", "value")
    per_value = long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return per_value.groupBy("col").agg(
        F.count("value").alias("n_distinct"),
        F.max(F.col("value").isNull().cast("int")).alias("has_null"))


def missing_count(df: DataFrame, cols: Sequence[str], out: str = "missing") -> DataFrame:
    """Per-row number of missing (NULL) values across ``cols``."""
    terms = [F.col(c).isNull().cast("int") for c in cols]
    return df.withColumn(out, balanced_sum(terms) if terms else F.lit(0))


def balanced_sum(terms: list[Column]) -> Column:
    """Sum of many terms as a balanced tree (a left-deep chain of hundreds
    of ``+`` overflows the analyzer's stack)."""
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        nxt = [terms[i] + terms[i + 1] for i in range(0, len(terms) - 1, 2)]
        if len(terms) % 2:
            nxt.append(terms[-1])
        terms = nxt
    return terms[0]
