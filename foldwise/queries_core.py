"""Queries for folds, target statistics and Gini."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.hashing import duck_hash_mod
from foldwise.operators import folds as fo
from foldwise.operators import metrics as me
from foldwise.operators import target as te
from foldwise.operators.nested import target_encode_nested
from foldwise.registry import register, round_doubles
from foldwise.sources import fixtures as fx
from foldwise.sources.fixtures import duck_with

CATS = fx.CAT_FEATURES


def _smooth_sql(n: str, m: str, prior: str, msl: float, sm: float) -> str:
    w = f"(1.0 / (1.0 + exp(-({n} - {float(msl)}) / {float(sm)})))"
    return f"({prior} * (1.0 - {w}) + {m} * {w})"


def _oof_sql(source: str, rows_filter: str, cols, msl, sm, suffix, plain=False, out_fold="fold",
             rows_expand: bool = False) -> str:
    """Naive per-fold self-join oracle for E9/E10: for model fold k, statistics
    over labelled rows with fold <> k."""
    extra = [
        ("tr", f"SELECT * FROM {source} WHERE fold IS NOT NULL"),
        ("ks", "SELECT DISTINCT fold AS k FROM tr"),
        ("pr", "SELECT ks.k, avg(CAST(tr.target AS DOUBLE)) AS prior FROM ks JOIN tr ON tr.fold <> ks.k GROUP BY ks.k"),
    ]
    for c in cols:
        extra.append((f"st_{c}", f"""
SELECT ks.k, CAST(tr.{c} AS VARCHAR) AS v, count(*) AS n, avg(CAST(tr.target AS DOUBLE)) AS m
FROM ks JOIN tr ON tr.fold <> ks.k WHERE tr.{c} IS NOT NULL GROUP BY ks.k, CAST(tr.{c} AS VARCHAR)"""))
    if rows_expand:
        extra.append(("rows_", f"SELECT r.*, ks.k AS {out_fold}_ FROM {source} r CROSS JOIN ks WHERE {rows_filter}"))
        kcol = f"r.{out_fold}_"
    else:
        extra.append(("rows_", f"SELECT r.*, r.fold AS {out_fold}_ FROM {source} r WHERE {rows_filter}"))
        kcol = f"r.{out_fold}_"
    sel, joins = [], []
    for c in cols:
        a = f"s_{c}"
        joins.append(f"LEFT JOIN st_{c} {a} ON {a}.k = {kcol} AND {a}.v = CAST(r.{c} AS VARCHAR)")
        if plain:
            sel.append(f"round({a}.m, 6) AS {c}{suffix}")
        else:
            sel.append(f"round(coalesce({_smooth_sql(f'{a}.n', f'{a}.m', 'pr.prior', msl, sm)}, pr.prior), 6) AS {c}{suffix}")
    body = (f"SELECT r.id, CAST({kcol} AS INT) AS {out_fold}, " + ", ".join(sel) +
            f"\nFROM rows_ r JOIN pr ON pr.k = {kcol}\n" + "\n".join(joins))
    return body, extra


_b, _e = _oof_sql("policy_folds", "r.fold IS NOT NULL", CATS, 200, 10, "_avg")
TE_OOF_SQL = duck_with(_b, "policy_folds", extra=_e)


@register("te_oof", TE_OOF_SQL)
def q_te_oof(spark, sf_dir):
    df = fx.policy_folds(spark, sf_dir)
    enc = te.target_encode_oof(df, CATS, min_samples_leaf=200, smoothing=10)
    return round_doubles(enc.select("id", "fold", *[c + "_avg" for c in CATS]))


_b, _e = _oof_sql("policy_folds", "r.split = 'test'", CATS, 200, 10, "_avg", rows_expand=True)
TE_TEST_SQL = duck_with(_b, "policy_folds", extra=_e)


@register("te_test_by_fold", TE_TEST_SQL)
def q_te_test_by_fold(spark, sf_dir):
    df = fx.policy_folds(spark, sf_dir)
    model = te.fit_target_encoding(df, CATS, min_samples_leaf=200, smoothing=10)
    test = df.filter("split = 'test'").drop("fold")
    enc = model.transform_each_fold(test, "_avg", "fold")
    return round_doubles(enc.select("id", "fold", *[c + "_avg" for c in CATS]))


_tb, _tx = _oof_sql("policy_folds", "r.fold IS NOT NULL", CATS, 200, 10, "_avg", out_fold="model_fold", rows_expand=True)


@register("te_train_by_fold", duck_with(
    f"SELECT b.*, CAST(p.fold AS INT) AS fold FROM ({_tb}) b JOIN policy_folds p USING (id) WHERE p.fold <> b.model_fold",
    "policy_folds", extra=_tx))
def q_te_train_by_fold(spark, sf_dir):
    """The train part of every fold model, encoded with the statistics it was fitted on."""
    df = fx.policy_folds(spark, sf_dir)
    model = te.fit_target_encoding(df, CATS, min_samples_leaf=200, smoothing=10)
    enc = model.transform_train_by_fold(df)
    return round_doubles(enc.select("id", "fold", "model_fold", *[c + "_avg" for c in CATS]))


@register("kfold", duck_with(
    f"SELECT id, split, CASE WHEN split = 'train' THEN CAST({duck_hash_mod(1024, 'id', 5)} AS INT) END AS fold FROM policy",
    "policy"))
def q_kfold(spark, sf_dir):
    return fo.kfold(fx.policy(spark, sf_dir), 5, 1024).select("id", "split", "fold")


def _gini_sql(src_name: str, src_sql: str, by: list[str], deps: list[str]) -> str:
    byc = ", ".join(by)
    part = f"PARTITION BY {byc} " if by else ""
    sel = f"{byc}, " if by else ""
    gb = f"GROUP BY {byc}" if by else ""
    body = f"""
SELECT {sel}round(2.0 * sum(pos * (coalesce(below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) - 1.0, 6) AS gini
FROM (SELECT {sel}pred, pos, neg,
             sum(neg) OVER ({part}ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM (SELECT {sel}pred, sum(CAST(y AS DOUBLE)) AS pos, sum(1.0 - y) AS neg FROM {src_name}
            WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY {sel}pred)) {gb}"""
    return duck_with(body, *deps, extra=[(src_name, src_sql)])


@register("gini", _gini_sql("src", "SELECT target AS y, price AS pred FROM policy WHERE split = 'train'",
                            [], ["policy"]))
def q_gini(spark, sf_dir):
    p = fx.policy(spark, sf_dir).filter("split = 'train'")
    return round_doubles(me.gini(p, "target", "price"))


@register("gini_ties", _gini_sql("src", "SELECT y, pred FROM ties", [], ["ties"]))
def q_gini_ties(spark, sf_dir):
    return round_doubles(me.gini(fx.ties(spark, sf_dir), "y", "pred"))


@register("gini_by_group", _gini_sql(
    "src", "SELECT s.model, s.fold, s.bag, p.target AS y, s.pred FROM scores s JOIN policy p USING (id) "
           "WHERE s.split = 'train'", ["model", "fold", "bag"], ["scores", "policy"]))
def q_gini_by_group(spark, sf_dir):
    s = fx.scores(spark, sf_dir).filter("split = 'train'")
    p = fx.policy(spark, sf_dir).select("id", "target")
    return round_doubles(me.gini(s.join(p, "id"), "target", "pred", ["model", "fold", "bag"]))


# ---------------------------------------------------------------- lineitem scale
LI_CATS = ["l_suppkey", "l_partkey", "l_linestatus", "l_linenumber"]
LI_SQL = (f"SELECT l_orderkey AS id, l_linenumber, CAST(l_returnflag = 'R' AS INT) AS target, "
          f"CAST({duck_hash_mod(1024, 'l_orderkey', 5)} AS INT) AS fold, l_suppkey, l_partkey, l_linestatus "
          f"FROM lineitem")


def lineitem_frame(spark, sf_dir):
    """``lineitem`` as a supervised table: label ``l_returnflag = 'R'``; folds
    are drawn per order (all lines of an order share a fold: group k-fold,
    since ``(l_orderkey, l_linenumber)`` is not a unique row key)."""
    from foldwise.functions.hashing import hash_mod
    from foldwise.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), "l_linenumber",
                     (F.col("l_returnflag") == "R").cast("int").alias("target"),
                     hash_mod(1024, "l_orderkey", 5).cast("int").alias("fold"),
                     "l_suppkey", "l_partkey", "l_linestatus")


_b, _e = _oof_sql("li", "r.fold IS NOT NULL", LI_CATS, 20, 10, "_avg")


@register("te_oof_lineitem", duck_with(_b, extra=[("li", LI_SQL)] + _e))
def q_te_oof_lineitem(spark, sf_dir):
    df = lineitem_frame(spark, sf_dir)
    enc = te.target_encode_oof(df, LI_CATS, min_samples_leaf=20, smoothing=10)
    return round_doubles(enc.select("id", "fold", *[c + "_avg" for c in LI_CATS]))


@register("group_mean_count_lineitem", duck_with(" UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, round(avg(CAST(target AS DOUBLE)), 6) AS mean, "
    f"count(*) AS count FROM li WHERE {c} IS NOT NULL GROUP BY {c}" for c in LI_CATS), extra=[("li", LI_SQL)]))
def q_group_mean_count_lineitem(spark, sf_dir):
    s = te.category_stats(lineitem_frame(spark, sf_dir), LI_CATS)
    return round_doubles(s.select("col", "value", (F.col("s") / F.col("n")).alias("mean"),
                                  F.col("n").alias("count")))


@register("gini_events", _gini_sql(
    "src", "SELECT event_type, CAST(user_id % 2 = 0 AS INT) AS y, value AS pred FROM events",
    ["event_type"], []))
def q_gini_events(spark, sf_dir):
    from foldwise.sources.tables import read_table
    ev = read_table(spark, sf_dir, "events").select(
        "event_type", (F.col("user_id") % 2 == 0).cast("int").alias("y"), F.col("value").alias("pred"))
    return round_doubles(me.gini(ev, "y", "pred", ["event_type"]))


# ------------------------------------------------------- documents x labels
DOC_CATS = ["lang", "source"]
DOC_SQL = (f"SELECT d.doc_id AS id, l.quality AS target, d.lang, d.source, "
           f"CASE WHEN l.quality IS NOT NULL THEN CAST({duck_hash_mod(1024, 'd.doc_id', 5)} AS INT) END AS fold "
           f"FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")


def documents_frame(spark, sf_dir):
    """Second supervised fixture: every document, label ``quality`` where
    ``labels`` has one (unlabelled documents play the test side)."""
    from foldwise.functions.hashing import hash_mod
    from foldwise.sources.tables import read_table
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    return j.select(F.col("doc_id").alias("id"), F.col("quality").alias("target"), "lang", "source",
                    F.when(F.col("quality").isNotNull(), hash_mod(1024, "doc_id", 5).cast("int")).alias("fold"))


_b, _e = _oof_sql("docs", "r.fold IS NOT NULL", DOC_CATS, 20, 10, "_avg")
_full = ", ".join(f"round(coalesce({_smooth_sql(f'a_{c}.n', f'a_{c}.m', 'pa.prior', 20, 10)}, pa.prior), 6) AS {c}_avg"
                  for c in DOC_CATS)
_u = (f"SELECT r.id, CAST(NULL AS INT) AS fold, {_full} FROM (SELECT * FROM docs WHERE fold IS NULL) r CROSS JOIN pa " +
      " ".join(f"LEFT JOIN a_{c} ON a_{c}.v = r.{c}" for c in DOC_CATS))
_e = _e + [("pa", "SELECT avg(CAST(target AS DOUBLE)) AS prior FROM tr")] + [
    (f"a_{c}", f"SELECT {c} AS v, count(*) AS n, avg(CAST(target AS DOUBLE)) AS m FROM tr WHERE {c} IS NOT NULL GROUP BY {c}")
    for c in DOC_CATS]


@register("te_oof_documents", duck_with(f"{_b}\nUNION ALL\n{_u}", extra=[("docs", DOC_SQL)] + _e))
def q_te_oof_documents(spark, sf_dir):
    """Labelled documents out of fold, unlabelled ones (the test side) from all labels."""
    df = documents_frame(spark, sf_dir)
    model = te.fit_target_encoding(df, DOC_CATS, min_samples_leaf=20, smoothing=10)
    enc = model.transform_fold_or_full(df)
    return round_doubles(enc.select("id", "fold", *[c + "_avg" for c in DOC_CATS]))


def _nested_sql(cols, msl, smooth) -> str:
    """By definition: one aggregate of the labelled rows per pair of folds, joined to the rows of the pair."""
    extra = [("pairs", "SELECT CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j FROM range(0, 5) a(i), range(0, 5) b(j)"),
             ("prior", "SELECT i, j, avg(CAST(target AS DOUBLE)) AS p FROM policy_folds CROSS JOIN pairs "
                       "WHERE fold IS NOT NULL AND fold <> i AND fold <> j GROUP BY i, j")]
    joins, outs = [], []
    for c in cols:
        w = f"(1.0 / (1.0 + exp(-(n - {msl}.0) / {smooth}.0)))"
        extra.append((f"e_{c}", f"SELECT i, j, v, p * (1.0 - {w}) + s / n * {w} AS e FROM (SELECT i, j, {c} AS v, CAST(count(*) AS DOUBLE) AS n, "
                                f"CAST(sum(target) AS DOUBLE) AS s FROM policy_folds CROSS JOIN pairs WHERE fold IS NOT NULL AND fold <> i AND fold <> j "
                                f"AND {c} IS NOT NULL GROUP BY i, j, v) JOIN prior USING (i, j)"))
        joins.append(f"LEFT JOIN e_{c} ON e_{c}.i = r.i AND e_{c}.j = r.j AND e_{c}.v = r.{c}")
        outs.append(f"round(coalesce(e_{c}.e, prior.p), 6) AS {c}_avg")
    return duck_with(
        "SELECT r.id, r.j AS model_fold, r.part, " + ", ".join(outs) + " FROM (SELECT f.*, m.j, coalesce(f.fold, m.j) AS i, "
        "CASE WHEN f.fold IS NULL THEN 'test' WHEN f.fold = m.j THEN 'valid' ELSE 'train' END AS part "
        "FROM policy_folds f CROSS JOIN (SELECT DISTINCT j FROM pairs) m) r JOIN prior ON prior.i = r.i AND prior.j = r.j " + " ".join(joins),
        "policy_folds", extra=extra)


@register("te_nested", _nested_sql(CATS, 200, 10))
def q_te_nested(spark, sf_dir):
    """Encodings of every fold model's train, held-out and test rows, none with the row's own label."""
    enc = target_encode_nested(fx.policy_folds(spark, sf_dir), CATS, min_samples_leaf=200, smoothing=10)
    return round_doubles(enc.select("id", "model_fold", "part", *[c + "_avg" for c in CATS]))
