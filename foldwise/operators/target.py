"""Target statistics per category: smoothed / out-of-fold target encoding and
out-of-fold mean projection (SURVEY E8-E11, A1-A3, J1/J2; plan 4.3 (a)).

All categorical columns are unpivoted to ``(col, value)`` and aggregated once:
one shuffle for any number of columns and folds, with map-side partial
aggregation, so a category holding a third of all rows costs one partial row
per task.  Per-fold sums are carried as ``n_j``/``s_j`` columns, so "fold j held
out" is ``total - fold j`` (integer sums, exact).  The fitted table (one row per
distinct value) is checkpointed; each column joins its slice back, broadcast
while the slices together stay under the configured bound of bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.session import broadcast_max_bytes, broadcast_max_rows, materialize

HOT_VALUES = 1000             # values that are split off from a shuffled dictionary, at most


def smoothing_weight(n: Column, min_samples_leaf: float, smoothing: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(n - F.lit(float(min_samples_leaf))) / F.lit(float(smoothing))))


def smoothed(n: Column, s: Column, prior: Column, min_samples_leaf: float, smoothing: float) -> Column:
    w = smoothing_weight(n, min_samples_leaf, smoothing)
    return prior * (F.lit(1.0) - w) + (s / n) * w


TOTAL = "__all__"      # pseudo-column whose single value carries the label totals


def category_stats(df: DataFrame, cols: list[str], label: str = "target",
                   fold_col: str | None = None, k: int = 0, with_total: bool = False) -> DataFrame:
    """A1/A2: ``(col, value, n, s, n_0, s_0, ...)`` over labelled rows; NULL values
    skipped.  With ``with_total`` the same aggregate also yields the row
    ``col = '__all__'`` holding the label totals (the priors) — no extra scan."""
    lab = df.filter(F.col(label).isNotNull())
    keep = [label] + ([fold_col] if fold_col else [])
    vals = [F.col(c).cast("string").alias(c) for c in cols]
    names = list(cols)
    if with_total:
        vals.append(F.lit("1").alias(TOTAL))
        names.append(TOTAL)
    slim = lab.select(*keep, *vals)
    long = slim.unpivot(keep, names, "col", "value").filter(F.col("value").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("s")]
    for j in range(k if fold_col else 0):
        in_j = F.col(fold_col) == j
        aggs.append(F.sum(F.when(in_j, 1).otherwise(0).cast("bigint")).alias(f"n_{j}"))
        aggs.append(F.sum(F.when(in_j, F.col(label)).otherwise(0).cast("bigint")).alias(f"s_{j}"))
    return long.groupBy("col", "value").agg(*aggs)


@dataclass
class TargetEncoding:
    """Fitted encoding: ``stats(col, value, enc array<double>, enc_full double)``.

    ``enc[j]`` is the encoding fitted without fold j; ``enc_full`` uses every
    labelled row.  ``priors[j]`` / ``prior_full`` replace unseen values
    (or NULL when ``unseen='null'``).
    """
    stats: DataFrame
    cols: list[str]
    k: int
    priors: list[float]
    prior_full: float
    counts: dict
    unseen: str
    rows: int = 0             # labelled rows

    def _prior(self, idx: Column | None) -> Column:
        if self.unseen == "null":
            return F.lit(None).cast("double")
        if idx is None:
            return F.lit(self.prior_full)
        arr = F.array(*[F.lit(p) for p in self.priors])
        return F.element_at(arr, idx + 1)

    def attach(self, df: DataFrame, what: Column, prefix: str = "_enc_") -> DataFrame:
        """``df`` with ``what`` (an expression over the fitted table) per column as ``<prefix><c>``,
        NULL where the value is unseen: one left join per column.

        Dictionaries are broadcast while their bytes together stay under the bound for one plan.  A
        larger one is joined by shuffle; its frequent values (at most ``HOT_VALUES``) are
        broadcast apart, and rows with a frequent or NULL value get a key of their own that
        spreads them, so no task receives a hot value."""
        spark = df.sparkSession
        room, out = broadcast_max_bytes(spark), df
        spread = F.concat(F.lit("\u0001"), F.xxhash64(*df.columns).cast("string"))
        for c in self.cols:
            side = self.stats.filter(F.col("col") == c).select(
                F.col("value").alias("_v"), what.alias(prefix + c), F.col("n").alias("_n"))
            n, width = self.counts.get(c, 0), 64 + 8 * (self.k + 1)
            key = F.col(c).cast("string")
            if n <= broadcast_max_rows(spark) and n * width <= room:
                room -= n * width
                out = out.join(F.broadcast(side.drop("_n")), key == F.col("_v"), "left").drop("_v")
                continue
            often = F.col("_n") > self.rows / HOT_VALUES
            hot = F.broadcast(side.filter(often).select(F.col("_v").alias("_h"), F.col(prefix + c).alias("_e")))
            out = out.join(hot, key == F.col("_h"), "left")
            out = out.withColumn("_k", F.when(key.isNull() | F.col("_h").isNotNull(), spread).otherwise(key))
            out = (out.join(side.filter(~often).drop("_n"), F.col("_k") == F.col("_v"), "left")
                   .withColumn(prefix + c, F.coalesce("_e", prefix + c)).drop("_h", "_e", "_k", "_v"))
        return out

    def _encoded(self, df: DataFrame, what: Column, value, suffix: str) -> DataFrame:
        joined = self.attach(df, what)
        return joined.select(*df.columns, *[value(F.col(f"_enc_{c}")).alias(c + suffix) for c in self.cols])

    def transform_fold(self, df: DataFrame, fold_col: str = "fold", suffix: str = "_avg") -> DataFrame:
        """Each row encoded with the statistics that exclude its own fold."""
        idx = F.col(fold_col)
        return self._encoded(df, F.col("enc"),
                             lambda e: F.coalesce(F.element_at(e, idx + 1), self._prior(idx)), suffix)

    def transform_each_fold(self, df: DataFrame, suffix: str = "_avg", fold_out: str = "fold") -> DataFrame:
        """Rows once per fold model j, encoded without fold j: joined once, then
        the arrays are exploded."""
        joined = self.attach(df, F.col("enc"))
        rows = joined.withColumn(fold_out, F.explode(F.sequence(F.lit(0), F.lit(self.k - 1))))
        idx = F.col(fold_out)
        return rows.select(*df.columns, fold_out, *[
            F.coalesce(F.element_at(F.col(f"_enc_{c}"), idx + 1), self._prior(idx)).alias(c + suffix)
            for c in self.cols])

    def transform_train_by_fold(self, df: DataFrame, fold_col: str = "fold", suffix: str = "_avg",
                                model_fold: str = "model_fold") -> DataFrame:
        """The train part of every fold model j: labelled rows with ``fold <> j``, encoded
        with the statistics of these same rows."""
        out = self.transform_each_fold(df.filter(F.col(fold_col).isNotNull()), suffix, model_fold)
        return out.filter(F.col(fold_col) != F.col(model_fold))

    def transform_full(self, df: DataFrame, suffix: str = "_avg") -> DataFrame:
        return self._encoded(df, F.col("enc_full"), lambda e: F.coalesce(e, self._prior(None)), suffix)

    def transform_fold_or_full(self, df: DataFrame, fold_col: str = "fold", suffix: str = "_avg") -> DataFrame:
        """Rows with a fold encoded without it, the others from all labelled rows, in one pass:
        the full encoding is element k + 1 of the array."""
        at = F.coalesce(F.col(fold_col), F.lit(self.k)) + 1
        prior = F.when(F.col(fold_col).isNull(), self._prior(None)).otherwise(self._prior(F.col(fold_col)))
        return self._encoded(df, F.concat("enc", F.array("enc_full")),
                             lambda e: F.coalesce(F.element_at(e, at), prior), suffix)


def fit_target_encoding(df: DataFrame, cols: list[str], label: str = "target",
                        fold_col: str | None = "fold", k: int = 5,
                        min_samples_leaf: float = 1, smoothing: float | None = 1,
                        unseen: str = "prior") -> TargetEncoding:
    """Fit E8/E9 (``smoothing`` set) or E10 plain means (``smoothing=None``).

    Rows with a NULL label never contribute.  With ``fold_col`` the statistics
    for "fold j held out" are kept for every j in one array column.
    """
    k = k if fold_col else 0
    raw = materialize(category_stats(df, cols, label, fold_col, k, with_total=True), "category-stats")
    # one small job: per-column dictionary sizes, and the totals row itself
    summary = raw.groupBy("col").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("n"), F.sum("s").alias("s"),
        *[F.sum(f"{x}_{j}").alias(f"{x}_{j}") for j in range(k) for x in ("n", "s")]).collect()
    trows = [r for r in summary if r["col"] == TOTAL]
    if not trows:
        raise ValueError("no labelled rows to fit target statistics on")
    trow = trows[0]
    counts = {r["col"]: r["_rows"] for r in summary if r["col"] != TOTAL}
    tot_n, tot_s = trow["n"], trow["s"]
    priors = []
    for j in range(k):
        denom = tot_n - trow[f"n_{j}"]
        priors.append((tot_s - trow[f"s_{j}"]) / denom if denom else None)
    prior_full_v = tot_s / tot_n if tot_n else None

    def enc(n: Column, s: Column, prior: float | None) -> Column:
        nd, sd = n.cast("double"), s.cast("double")
        p = F.lit(prior).cast("double")
        if smoothing is None:
            return F.when(nd > 0, sd / nd)
        value = smoothed(nd, sd, p, min_samples_leaf, smoothing)
        return F.when(nd > 0, value).otherwise(p if unseen == "prior" else F.lit(None).cast("double"))

    per_fold = [enc(F.col("n") - F.col(f"n_{j}"), F.col("s") - F.col(f"s_{j}"), priors[j]) for j in range(k)]
    fitted = raw.filter(F.col("col") != TOTAL).select(
        "col", "value",
        (F.array(*per_fold) if per_fold else F.array().cast("array<double>")).alias("enc"),
        enc(F.col("n"), F.col("s"), prior_full_v).alias("enc_full"),
        F.col("n"))
    return TargetEncoding(fitted, list(cols), k, priors, prior_full_v, counts, unseen, tot_n)


def target_encode_oof(df: DataFrame, cols: list[str], label: str = "target", fold_col: str = "fold",
                      k: int = 5, min_samples_leaf: float = 200, smoothing: float = 10,
                      suffix: str = "_avg") -> DataFrame:
    """Every labelled row encoded with its own fold held out (leak-free)."""
    model = fit_target_encoding(df, cols, label, fold_col, k, min_samples_leaf, smoothing)
    return model.transform_fold(df.filter(F.col(fold_col).isNotNull()), fold_col, suffix)


def target_encode_full(df: DataFrame, cols: list[str], label: str = "target",
                       min_samples_leaf: float = 1, smoothing: float = 1, suffix: str = "_avg",
                       leak_ok: bool = False) -> DataFrame:
    """Fit on every labelled row and apply to all rows: the labelled ones (this leaks
    their label) and the unlabelled."""
    if not leak_ok:
        raise ValueError("full-data target encoding sees each row's own label; pass leak_ok=True")
    model = fit_target_encoding(df, cols, label, None, 0, min_samples_leaf, smoothing)
    return model.transform_full(df, suffix)


def oof_mean(df: DataFrame, cols: list[str], label: str = "target", fold_col: str = "fold",
             k: int = 5, prefix: str = "loo_", drop_source: bool = True) -> DataFrame:
    """Plain category mean; labelled rows out of fold, unlabelled rows from all
    labelled rows; unseen -> NULL.  (Not leave-one-out, despite the name.)"""
    model = fit_target_encoding(df, cols, label, fold_col, k, smoothing=None, unseen="null")
    out = model.transform_fold_or_full(df, fold_col, "_oofm")
    ren = [F.col(c + "_oofm").alias(prefix + c) for c in cols]
    keep = [c for c in df.columns if not (drop_source and c in cols)]
    return out.select(*keep, *ren)
