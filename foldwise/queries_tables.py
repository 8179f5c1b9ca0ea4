"""Queries for scans, sinks, projections, statistics and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import encode as en
from foldwise.operators import folds as fo
from foldwise.operators import metrics as me
from foldwise.operators import scale as sc
from foldwise.operators import schema as sh
from foldwise.operators import stats as st
from foldwise.registry import register, round_doubles
from foldwise.sources import features as sf
from foldwise.sources import fixtures as fx
from foldwise.sources import predictions as pr
from foldwise.sources.fixtures import duck_with
from foldwise.sources.tables import read_table

FEATS = fx.FEATURES
NUM = fx.NUMERIC_FEATURES
STAMP = "20261203-0000"


def _r(x: str) -> str:
    return f"round({x}, 6)"


# ---------------------------------------------------------------- S: sources
@register("scan_policy", duck_with("SELECT * FROM policy_sentinel", "policy_sentinel"))
def q_scan_policy(spark, sf_dir):
    return round_doubles(fx.policy(spark, sf_dir, sentinel_null=False))


@register("scan_labelled", duck_with("SELECT id, target, split, price, bal, age, cust_cat FROM policy", "policy"))
def q_scan_labelled(spark, sf_dir):
    """Train and test written as CSV with the sentinel, read with a schema, united with ``split``."""
    from foldwise.session import scratch_path
    from foldwise.sources.scan import read_frame, read_labelled
    raw = fx.policy(spark, sf_dir, sentinel_null=False).select("id", "target", "price", "bal", "age", "cust_cat", "split")
    frames, sizes = [], []
    for split in ("train", "test"):
        part = raw.filter(F.col("split") == split).drop("split", *(["target"] if split == "test" else []))
        path = scratch_path(spark, f"csv-{split}")
        part.write.option("header", True).csv(path)
        frames.append(read_frame(spark, path, part.schema, fmt="csv", sentinel="-1"))
        sizes.append(part.count())
    return round_doubles(read_labelled(*frames, expect=tuple(sizes)))


@register("scan_sentinel_null", duck_with("SELECT * FROM policy", "policy"))
def q_scan_sentinel_null(spark, sf_dir):
    from foldwise.sources.scan import sentinel_as_null
    raw = fx.policy(spark, sf_dir, sentinel_null=False)
    return round_doubles(sentinel_as_null(raw, NUM))


@register("expect_rows", duck_with("SELECT count(*) AS n_rows FROM policy", "policy"))
def q_expect_rows(spark, sf_dir):
    n = read_table(spark, sf_dir, "orders").count()     # every order has a customer
    df = sh.expect_rows(fx.policy(spark, sf_dir), n)
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


@register("join_feature_table", duck_with(
    "SELECT p.id, p.target, p.split, p.price, f.f1, f.f2, f.f3 FROM policy p JOIN features_ext f USING (id)",
    "policy", "features_ext"))
def q_join_feature_table(spark, sf_dir):
    rows = fx.policy(spark, sf_dir).select("id", "target", "split", "price")
    return round_doubles(sf.join_feature_table(rows, fx.features_ext(spark, sf_dir)))


@register("join_feature_table_partial", duck_with(
    "SELECT p.id, p.price, f.f1, f.f2 FROM policy p LEFT JOIN (SELECT * FROM features_ext WHERE id % 3 <> 0) f USING (id)",
    "policy", "features_ext"))
def q_join_feature_table_partial(spark, sf_dir):
    """Rows without an entry in the feature table stay, with NULL features."""
    rows = fx.policy(spark, sf_dir).select("id", "price")
    feats = fx.features_ext(spark, sf_dir).filter("id % 3 <> 0").select("id", "f1", "f2")
    return round_doubles(sf.join_feature_table(rows, feats, check=False))


@register("replace_cats_with_encoding", duck_with(
    "SELECT p.id, p.target, p.split, p.debt_bin, p.price, p.bal, p.age, f.f1, f.f2, f.f3 "
    "FROM policy p JOIN features_ext f USING (id)", "policy", "features_ext"))
def q_replace_cats(spark, sf_dir):
    return round_doubles(sf.replace_cats_with_encoding(fx.policy(spark, sf_dir), fx.features_ext(spark, sf_dir)))


@register("persist_features", duck_with(
    "SELECT id, price, bal, age, split FROM policy", "policy"))
def q_persist_features(spark, sf_dir):
    df = fx.policy(spark, sf_dir).select("id", "price", "bal", "age", "split")
    path = sf.persist_features(df)
    both = sf.read_features(spark, path, "train").unionByName(sf.read_features(spark, path, "test"))
    return round_doubles(both.select("id", "price", "bal", "age", "split"))


def _scores_final_sql() -> list[tuple[str, str]]:
    return [("fin", "SELECT id, model, split, avg(pred) AS pred FROM scores GROUP BY id, model, split"),
            ("lab", "SELECT id, target AS y FROM policy WHERE split = 'train'"),
            ("oof", "SELECT f.model, s.fold, f.pred, l.y FROM fin f JOIN lab l USING (id) "
                    "JOIN (SELECT DISTINCT id, fold FROM scores WHERE split = 'train') s USING (id) "
                    "WHERE f.split = 'train'"),
            ("g_fold", """SELECT model, fold, 2.0 * sum(pos * (coalesce(below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) - 1.0 AS g
FROM (SELECT model, fold, pred, pos, neg, sum(neg) OVER (PARTITION BY model, fold ORDER BY pred
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM (SELECT model, fold, pred, sum(CAST(y AS DOUBLE)) AS pos, sum(1.0 - y) AS neg
            FROM oof GROUP BY model, fold, pred)) GROUP BY model, fold"""),
            ("g_full", """SELECT model, 2.0 * sum(pos * (coalesce(below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) - 1.0 AS full_gini
FROM (SELECT model, pred, pos, neg, sum(neg) OVER (PARTITION BY model ORDER BY pred
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM (SELECT model, pred, sum(CAST(y AS DOUBLE)) AS pos, sum(1.0 - y) AS neg
            FROM oof GROUP BY model, pred)) GROUP BY model"""),
            ("summ", "SELECT g.model, avg(g) AS mean_gini, stddev_pop(g) AS std_gini, max(f.full_gini) AS full_gini "
                     "FROM g_fold g JOIN g_full f USING (model) GROUP BY g.model")]


def _final_summary(spark, sf_dir):
    s = fx.scores(spark, sf_dir)
    final = pr.final_predictions(s)
    folds = s.filter("split = 'train'").select("id", "fold").distinct()
    oof = final.filter("split = 'train'").join(folds, "id").withColumn("split", F.lit("train"))
    lab = fx.policy(spark, sf_dir).select("id", "target")
    summ = me.cv_summary(oof.withColumn("bag", F.lit(0)), lab, by=["model"])
    return s, summ


@register("write_predictions", duck_with(
    "SELECT model, split, count(*) AS n_rows, round(sum(pred), 6) AS sum_pred FROM fin GROUP BY model, split",
    "scores", "policy", extra=_scores_final_sql()))
def q_write_predictions(spark, sf_dir):
    s, summ = _final_summary(spark, sf_dir)
    path = pr.write_predictions(s, summ, STAMP)
    back = pr.parse_run_names(pr.scan_predictions(spark, path))
    return round_doubles(back.groupBy("model", "split").agg(F.count(F.lit(1)).alias("n_rows"),
                                                          F.sum("pred").alias("sum_pred")))


@register("scan_predictions", duck_with("SELECT id, model, split, round(pred, 6) AS pred FROM fin",
                                        "scores", "policy", extra=_scores_final_sql()))
def q_scan_predictions(spark, sf_dir):
    s, summ = _final_summary(spark, sf_dir)
    path = pr.write_predictions(s, summ, STAMP)
    back = pr.parse_run_names(pr.scan_predictions(spark, path))
    return round_doubles(back.select("id", "model", "split", "pred"))


@register("parse_run_names", duck_with(
    f"SELECT '{STAMP}' AS stamp, model, round(mean_gini, 5) AS mean_gini, round(full_gini, 5) AS full_gini, "
    "round(std_gini, 5) AS std_gini FROM summ", "scores", "policy", extra=_scores_final_sql()))
def q_parse_run_names(spark, sf_dir):
    s, summ = _final_summary(spark, sf_dir)
    path = pr.write_predictions(s, summ, STAMP)
    back = pr.parse_run_names(pr.scan_predictions(spark, path))
    return back.select("stamp", "model", "mean_gini", "full_gini", "std_gini").distinct()


# ------------------------------------------------------ P: schema operators
@register("drop_columns", duck_with("SELECT * EXCLUDE (debt_bin, calc_01) FROM policy", "policy"))
def q_drop_columns(spark, sf_dir):
    return round_doubles(sh.drop_columns(fx.policy(spark, sf_dir), ["debt_bin", "calc_01"]))


@register("drop_prefix", duck_with("SELECT * EXCLUDE (calc_01) FROM policy", "policy"))
def q_drop_prefix(spark, sf_dir):
    return round_doubles(sh.drop_prefix(fx.policy(spark, sf_dir), "calc_"))


@register("select_features", duck_with("SELECT id, price, prio_cat, bal, nation_cat FROM policy", "policy"))
def q_select_features(spark, sf_dir):
    return round_doubles(sh.select_features(fx.policy(spark, sf_dir), ["price", "prio_cat", "bal", "nation_cat"]))


@register("reorder", duck_with(f"SELECT id, {', '.join(FEATS)}, target FROM policy", "policy"))
def q_reorder(spark, sf_dir):
    return round_doubles(sh.reorder(fx.policy(spark, sf_dir).drop("split")))


_NARROW = {"prio_cat": "TINYINT", "nation_cat": "TINYINT", "cust_cat": "SMALLINT", "month_cat": "TINYINT",
           "debt_bin": "TINYINT", "price": "FLOAT", "bal": "FLOAT", "age": "TINYINT", "calc_01": "TINYINT"}


@register("narrow_types", duck_with(
    "SELECT id, seg_cat, " + ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _NARROW.items()) + " FROM policy",
    "policy"))
def q_narrow_types(spark, sf_dir):
    df = fx.policy(spark, sf_dir).select("id", "seg_cat", *_NARROW)
    return sh.narrow_types(df, list(_NARROW))


@register("fold_slices", duck_with(
    "SELECT CAST(k AS INT) AS model_fold, CASE WHEN fold = k THEN 'valid' ELSE 'train' END AS part, "
    "count(*) AS n FROM policy_folds CROSS JOIN range(0, 5) ks(k) WHERE fold IS NOT NULL GROUP BY ALL",
    "policy_folds"))
def q_fold_slices(spark, sf_dir):
    sl = fo.fold_slices(fx.policy_folds(spark, sf_dir), 5)
    return sl.groupBy("model_fold", "part").agg(F.count(F.lit(1)).alias("n"))


@register("replace_value", duck_with(
    "SELECT id, CASE WHEN prio_cat = 3 THEN -1 ELSE prio_cat END AS prio_cat FROM policy", "policy"))
def q_replace_value(spark, sf_dir):
    return sh.replace_value(fx.policy(spark, sf_dir), "prio_cat", 3, -1).select("id", "prio_cat")


@register("impute_mean", duck_with(
    "SELECT p.id, round(coalesce(p.bal, m.mb), 6) AS bal, round(coalesce(CAST(p.age AS DOUBLE), m.ma), 6) AS age "
    "FROM policy p CROSS JOIN (SELECT avg(bal) AS mb, avg(age) AS ma FROM policy WHERE split = 'train') m",
    "policy"))
def q_impute_mean(spark, sf_dir):
    p = fx.policy(spark, sf_dir)
    out = sc.impute_mean(p, ["bal", "age"], fit=p.filter("split = 'train'"))
    return round_doubles(out.select("id", "bal", "age"))


@register("compose_pipeline", duck_with(
    "SELECT id, target, split, prio_cat, nation_cat, cust_cat, month_cat, debt_bin, round(price, 6) AS price, "
    "round(bal, 6) AS bal, age, " + " + ".join(f"CAST({c} IS NULL AS INT)" for c in
                                               ["prio_cat", "nation_cat", "cust_cat", "month_cat", "debt_bin",
                                                "price", "bal", "age"]) +
    " AS missing, round(price * bal, 6) AS price_x_bal FROM policy", "policy"))
def q_compose_pipeline(spark, sf_dir):
    from foldwise.spec import FeatureSpec
    spec = FeatureSpec()                      # roles from name conventions (P3)
    p = fx.policy(spark, sf_dir)
    kept = [c for c in spec.features(p) if c not in spec.droppable(p) and c != "seg_cat"]
    steps = [(sh.drop_prefix, {"prefix": spec.drop_prefix}),
             (sh.drop_columns, {"names": ["seg_cat"]}),
             (st.missing_count, {"cols": kept}),
             (en.product_feature, {"a": "price", "b": "bal"})]
    return round_doubles(sh.compose(p, steps))


@register("add_placeholder", duck_with(
    "SELECT id, CAST(NULL AS INT) AS target FROM policy WHERE split = 'test'", "policy"))
def q_add_placeholder(spark, sf_dir):
    test = fx.policy(spark, sf_dir).filter("split = 'test'").select("id")
    return sh.add_placeholder(test, "target")


# ------------------------------------------------------------ A: statistics
CAT_Q = fx.CAT_FEATURES


@register("group_mean_count", duck_with(" UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, round(avg(CAST(target AS DOUBLE)), 6) AS mean, "
    f"count(*) AS count FROM policy WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c}" for c in CAT_Q),
    "policy"))
def q_group_mean_count(spark, sf_dir):
    from foldwise.operators.target import category_stats
    s = category_stats(fx.policy(spark, sf_dir), CAT_Q)
    return round_doubles(s.select("col", "value", (F.col("s") / F.col("n")).alias("mean"),
                                  F.col("n").alias("count")))


@register("column_stats", duck_with(" UNION ALL ".join(
    f"SELECT '{c}' AS col, count({c}) AS n, {_r(f'avg({c})')} AS mean, {_r(f'median(CAST({c} AS DOUBLE))')} AS median, "
    f"{_r(f'skewness({c})')} AS skew, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"{_r(f'stddev_pop({c})')} AS std_pop FROM policy WHERE split = 'train'" for c in NUM), "policy"))
def q_column_stats(spark, sf_dir):
    p = fx.policy(spark, sf_dir).filter("split = 'train'")
    return round_doubles(st.column_stats(p, NUM))


@register("column_distincts", duck_with(" UNION ALL ".join(
    f"SELECT '{c}' AS col, count(DISTINCT {c}) AS n_distinct, max(CAST({c} IS NULL AS INT)) AS has_null "
    f"FROM policy" for c in FEATS), "policy"))
def q_column_distincts(spark, sf_dir):
    return st.column_distincts(fx.policy(spark, sf_dir), FEATS)


@register("missing_count", duck_with(
    "SELECT id, " + " + ".join(f"CAST({c} IS NULL AS INT)" for c in FEATS) + " AS missing FROM policy", "policy"))
def q_missing_count(spark, sf_dir):
    return st.missing_count(fx.policy(spark, sf_dir), FEATS).select("id", "missing")


@register("missing_count_scaled", duck_with(
    "SELECT id, round(CASE WHEN hi > lo THEN (m - lo) / (hi - lo) ELSE 0.0 END, 6) AS negative_one_vals "
    "FROM (SELECT id, split, " + " + ".join(f"CAST({c} IS NULL AS INT)" for c in FEATS) + " AS m FROM policy) "
    "CROSS JOIN (SELECT min(m2) AS lo, max(m2) AS hi FROM (SELECT " +
    " + ".join(f"CAST({c} IS NULL AS INT)" for c in FEATS) + " AS m2 FROM policy WHERE split = 'train'))",
    "policy"))
def q_missing_count_scaled(spark, sf_dir):
    p = fx.policy(spark, sf_dir)
    out = en.missing_count_scaled(p, FEATS, F.col("split") == "train")
    return round_doubles(out.select("id", "negative_one_vals"))


SCALE_COLS = ["price", "bal", "age"]


@register("standard_scale", duck_with(
    "SELECT id, " + ", ".join(f"round_even((CAST({c} AS DOUBLE) - mu_{c}) / sd_{c}, 6) AS {c}" for c in SCALE_COLS) +
    " FROM policy CROSS JOIN (SELECT " +
    ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in SCALE_COLS) + " FROM policy)", "policy"))
def q_standard_scale(spark, sf_dir):
    p = fx.policy(spark, sf_dir).select("id", *SCALE_COLS)
    return sc.standard_scale(p, SCALE_COLS, digits=6)


@register("scale_no_center", duck_with(
    "SELECT id, " + ", ".join(f"round({c} / sd_{c}, 6) AS {c}" for c in SCALE_COLS) +
    " FROM policy CROSS JOIN (SELECT " + ", ".join(f"stddev_pop({c}) AS sd_{c}" for c in SCALE_COLS) +
    " FROM policy WHERE split = 'train')", "policy"))
def q_scale_no_center(spark, sf_dir):
    p = fx.policy(spark, sf_dir)
    out = sc.scale_no_center(p.select("id", "split", *SCALE_COLS), SCALE_COLS, fit=p.filter("split = 'train'"))
    return round_doubles(out.select("id", *SCALE_COLS))


@register("minmax_scale", duck_with(
    "SELECT id, " + ", ".join(f"round((CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c}), 6) AS {c}" for c in SCALE_COLS) +
    " FROM policy CROSS JOIN (SELECT " +
    ", ".join(f"CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}" for c in SCALE_COLS) +
    " FROM policy WHERE split = 'train')", "policy"))
def q_minmax_scale(spark, sf_dir):
    p = fx.policy(spark, sf_dir)
    out = sc.minmax_scale(p.select("id", "split", *SCALE_COLS), SCALE_COLS, fit=p.filter("split = 'train'"))
    return round_doubles(out.select("id", *SCALE_COLS))


@register("cv_summary", duck_with(
    "SELECT model, bag, round(avg(g), 6) AS mean_gini, round(stddev_pop(g), 6) AS std_gini, "
    "round(max(full_gini), 6) AS full_gini, count(g) AS folds FROM gf JOIN gl USING (model, bag) GROUP BY model, bag",
    "scores", "policy", extra=[
        ("oof", "SELECT s.model, s.bag, s.fold, s.pred, p.target AS y FROM scores s JOIN policy p USING (id) "
                "WHERE s.split = 'train'"),
        ("gf", """SELECT model, bag, fold, 2.0 * sum(pos * (coalesce(below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) - 1.0 AS g
FROM (SELECT *, sum(neg) OVER (PARTITION BY model, bag, fold ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM (SELECT model, bag, fold, pred, sum(CAST(y AS DOUBLE)) AS pos, sum(1.0 - y) AS neg FROM oof GROUP BY ALL))
GROUP BY model, bag, fold"""),
        ("gl", """SELECT model, bag, 2.0 * sum(pos * (coalesce(below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) - 1.0 AS full_gini
FROM (SELECT *, sum(neg) OVER (PARTITION BY model, bag ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM (SELECT model, bag, pred, sum(CAST(y AS DOUBLE)) AS pos, sum(1.0 - y) AS neg FROM oof GROUP BY ALL))
GROUP BY model, bag""")]))
def q_cv_summary(spark, sf_dir):
    s = fx.scores(spark, sf_dir)
    lab = fx.policy(spark, sf_dir).select("id", "target")
    return round_doubles(me.cv_summary(s, lab, by=["model", "bag"]))


@register("bag_average", duck_with(
    "SELECT id, model, split, round(avg(pred), 6) AS pred FROM scores GROUP BY id, model, split", "scores"))
def q_bag_average(spark, sf_dir):
    return round_doubles(pr.final_predictions(fx.scores(spark, sf_dir)))


@register("fold_average", duck_with(
    "SELECT id, model, bag, round(sum(pred) / 5.0, 6) AS pred FROM scores WHERE split = 'test' "
    "GROUP BY id, model, bag", "scores"))
def q_fold_average(spark, sf_dir):
    s = fx.scores(spark, sf_dir).filter("split = 'test'")
    k = 5
    return round_doubles(s.groupBy("id", "model", "bag").agg((F.sum("pred") / k).alias("pred")))
