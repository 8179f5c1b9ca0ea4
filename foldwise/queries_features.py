"""Queries for encoders, expression features, cluster features, folds and
prediction blends (SURVEY 2.5-2.10, Y rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import scalar as fn
from foldwise.operators import cluster as cl
from foldwise.operators import encode as en
from foldwise.operators import express as ex
from foldwise.operators import folds as fo
from foldwise.operators import scale as sc
from foldwise.operators import target as te
from foldwise.registry import register, round_doubles
from foldwise.sources import fixtures as fx
from foldwise.sources import predictions as pr
from foldwise.sources.features import join_feature_table
from foldwise.sources.fixtures import duck_with
from foldwise.sources.tables import read_table

CATS = fx.CAT_FEATURES
FEATS = fx.FEATURES


def _r(x: str) -> str:
    return f"round({x}, 6)"


# ------------------------------------------------------------- W1, E2, E3
LE_COLS = ["prio_cat", "seg_cat", "cust_cat", "age"]


@register("label_encode", duck_with(
    "SELECT p.id, " + ", ".join(f"d_{c}.code AS {c}" for c in LE_COLS) + " FROM policy p " +
    " ".join(f"LEFT JOIN d_{c} ON p.{c} = d_{c}.v" for c in LE_COLS), "policy",
    extra=[(f"d_{c}", f"SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code "
                      f"FROM (SELECT DISTINCT {c} AS v FROM policy WHERE {c} IS NOT NULL)") for c in LE_COLS]))
def q_label_encode(spark, sf_dir):
    p = fx.policy(spark, sf_dir).select("id", *LE_COLS)
    return en.label_encode(p, LE_COLS)


def _pair_sql(a, b, name):
    d = (f"d_{a}_{b}", f"SELECT a, b, CAST(row_number() OVER (ORDER BY a NULLS FIRST, b NULLS FIRST) - 1 AS INT) "
                       f"AS code FROM (SELECT DISTINCT {a} AS a, {b} AS b FROM policy)")
    sel = f'd_{a}_{b}.code AS "{name}"'
    join = f"JOIN d_{a}_{b} ON p.{a} IS NOT DISTINCT FROM d_{a}_{b}.a AND p.{b} IS NOT DISTINCT FROM d_{a}_{b}.b"
    return d, sel, join


_PAIRS = [("prio_cat", "nation_cat"), ("seg_cat", "month_cat")]
_ps = [_pair_sql(a, b, f"{a}|{b}") for a, b in _PAIRS]


@register("interact", duck_with("SELECT p.id, " + ", ".join(s for _, s, _ in _ps) + " FROM policy p " +
                                " ".join(j for _, _, j in _ps), "policy", extra=[d for d, _, _ in _ps]))
def q_interact(spark, sf_dir):
    p = fx.policy(spark, sf_dir).select("id", "prio_cat", "nation_cat", "seg_cat", "month_cat")
    return en.interact(p, _PAIRS).select("id", *[f"`{a}|{b}`" for a, b in _PAIRS])


_pp = _pair_sql("nation_cat", "month_cat", "nation_cat_plus_month_cat")


@register("interact_plus", duck_with(f"SELECT p.id, {_pp[1]} FROM policy p {_pp[2]}", "policy", extra=[_pp[0]]))
def q_interact_plus(spark, sf_dir):
    p = fx.policy(spark, sf_dir).select("id", "nation_cat", "month_cat")
    return en.interact(p, [("nation_cat", "month_cat")], "{a}_plus_{b}").select("id", "nation_cat_plus_month_cat")


# ------------------------------------------------------------- E4, E5, E6
def _sparse(df, key, new_cols):
    """Indicator columns as sparse pairs (key, feature) where the indicator is 1."""
    if not new_cols:           # nothing passed the threshold/gate: no pairs
        return df.select(key, F.lit(None).cast("string").alias("feature")).filter(F.lit(False))
    long = df.select(key, *[F.col(f"`{c}`").alias(c) for c in new_cols]).unpivot([key], new_cols, "feature", "on")
    return long.filter(F.col("on") == 1).select(key, "feature")


OH_COLS = ["prio_cat", "nation_cat", "seg_cat", "month_cat"]


@register("one_hot", duck_with(" UNION ALL ".join(
    f"SELECT id, '{c}_' || CAST({c} AS VARCHAR) AS feature FROM policy WHERE {c} IS NOT NULL" for c in OH_COLS),
    "policy"))
def q_one_hot(spark, sf_dir):
    p = fx.policy(spark, sf_dir).select("id", *OH_COLS)
    wide = en.one_hot(p, OH_COLS)
    return _sparse(wide, "id", [c for c in wide.columns if c != "id"])


PART_COLS = ["p_brand", "p_type", "p_size"]


@register("one_hot_threshold", duck_with(
    "SELECT p_partkey, col || '_' || v AS feature FROM long JOIN kept USING (col, v)", extra=[
        ("long", " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM part"
                                    for c in PART_COLS)),
        ("kept", "SELECT col, v FROM long GROUP BY col, v HAVING count(*) >= 50")]))
def q_one_hot_threshold(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", *PART_COLS)
    wide = en.one_hot(p, PART_COLS, threshold=50)
    return _sparse(wide, "p_partkey", [c for c in wide.columns if c != "p_partkey"])


@register("one_hot_lowcard", duck_with(" UNION ALL ".join(
    f"SELECT id, '{c}_oh_' || CAST({c} AS VARCHAR) AS feature FROM policy "
    f"WHERE {c} IN (SELECT {c} FROM policy WHERE split = 'train') AND "
    f"(SELECT count(DISTINCT {c}) + max(CAST({c} IS NULL AS INT)) FROM policy WHERE split = 'train') BETWEEN 3 AND 6"
    for c in FEATS), "policy"))
def q_one_hot_lowcard(spark, sf_dir):
    p = fx.policy(spark, sf_dir).select("id", "split", *FEATS)
    wide = en.one_hot_lowcard(p, FEATS, fit=p.filter("split = 'train'"))
    return _sparse(wide, "id", [c for c in wide.columns if "_oh_" in c])


# --------------------------------------------------------------------- E7
FLAG_COLS = [c for c in fx.NUMERIC_FEATURES if "_bin" not in c]


@register("mean_median_flags", duck_with(
    "SELECT id, " + ", ".join(f"coalesce(CAST({c} > med_{c} AS INT), 0) AS {c}_median_range, "
                              f"coalesce(CAST({c} > mu_{c} AS INT), 0) AS {c}_mean_range" for c in FLAG_COLS) +
    " FROM policy CROSS JOIN (SELECT " +
    ", ".join(f"median(CAST({c} AS DOUBLE)) AS med_{c}, avg({c}) AS mu_{c}" for c in FLAG_COLS) +
    " FROM policy WHERE split = 'train')", "policy"))
def q_mean_median_flags(spark, sf_dir):
    p = fx.policy(spark, sf_dir).select("id", "split", *FLAG_COLS)
    out = en.mean_median_flags(p, FLAG_COLS, fit=p.filter("split = 'train'"))
    return out.drop("split", *FLAG_COLS)


# --------------------------------------------------------- E8, E10, E11
def _smooth(n, m, prior, msl=200.0, sm=10.0):
    w = f"(1.0 / (1.0 + exp(-(CAST({n} AS DOUBLE) - {msl}) / {sm})))"
    return f"({prior} * (1.0 - {w}) + {m} * {w})"


@register("te_smoothed", duck_with(
    "SELECT r.id, r.part, " + ", ".join(
        f"{_r(f'coalesce({_smooth(f's_{c}.n', f's_{c}.m', 'pr.prior')}, pr.prior)')} AS {c}_mean" for c in CATS) +
    " FROM (SELECT *, CASE WHEN split = 'test' THEN 'tst' WHEN fold = 0 THEN 'val' ELSE 'trn' END AS part FROM policy_folds "
    ") r CROSS JOIN pr " +
    " ".join(f"LEFT JOIN s_{c} ON s_{c}.v = CAST(r.{c} AS VARCHAR)" for c in CATS), "policy_folds",
    extra=[("trn", "SELECT * FROM policy_folds WHERE fold <> 0"),
           ("pr", "SELECT avg(CAST(target AS DOUBLE)) AS prior FROM trn")] +
          [(f"s_{c}", f"SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, avg(CAST(target AS DOUBLE)) AS m FROM trn "
                      f"WHERE {c} IS NOT NULL GROUP BY 1") for c in CATS]))
def q_te_smoothed(spark, sf_dir):
    df = fx.policy_folds(spark, sf_dir)
    model = te.fit_target_encoding(df.filter("fold <> 0"), CATS, fold_col=None, min_samples_leaf=200, smoothing=10)
    rows = df.withColumn("part", F.when(F.col("split") == "test", "tst").when(F.col("fold") == 0, "val")
                         .otherwise("trn"))
    out = model.transform_full(rows, "_mean")
    return round_doubles(out.select("id", "part", *[c + "_mean" for c in CATS]))


@register("te_full", duck_with(
    "SELECT r.id, " + ", ".join(
        f"{_r(f'coalesce({_smooth(f's_{c}.n', f's_{c}.m', 'pr.prior')}, pr.prior)')} AS {c}_avg" for c in CATS) +
    " FROM policy r CROSS JOIN pr " +
    " ".join(f"LEFT JOIN s_{c} ON s_{c}.v = CAST(r.{c} AS VARCHAR)" for c in CATS), "policy",
    extra=[("trn", "SELECT * FROM policy WHERE split = 'train'"),
           ("pr", "SELECT avg(CAST(target AS DOUBLE)) AS prior FROM trn")] +
          [(f"s_{c}", f"SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, avg(CAST(target AS DOUBLE)) AS m FROM trn "
                      f"WHERE {c} IS NOT NULL GROUP BY 1") for c in CATS]))
def q_te_full(spark, sf_dir):
    p = fx.policy(spark, sf_dir)
    out = te.target_encode_full(p, CATS, min_samples_leaf=200, smoothing=10, leak_ok=True)
    return round_doubles(out.select("id", *[c + "_avg" for c in CATS]))


def _oof_mean_sql():
    extra = [("tr", "SELECT * FROM policy_folds WHERE fold IS NOT NULL"),
             ("ks", "SELECT DISTINCT fold AS k FROM tr")]
    for c in CATS:
        extra.append((f"so_{c}", f"SELECT ks.k, CAST(tr.{c} AS VARCHAR) AS v, avg(CAST(tr.target AS DOUBLE)) AS m "
                                 f"FROM ks JOIN tr ON tr.fold <> ks.k WHERE tr.{c} IS NOT NULL GROUP BY 1, 2"))
        extra.append((f"sf_{c}", f"SELECT CAST({c} AS VARCHAR) AS v, avg(CAST(target AS DOUBLE)) AS m FROM tr "
                                 f"WHERE {c} IS NOT NULL GROUP BY 1"))
    train = ("SELECT r.id, " + ", ".join(f"{_r(f'so_{c}.m')} AS loo_{c}" for c in CATS) + " FROM tr r " +
             " ".join(f"LEFT JOIN so_{c} ON so_{c}.k = r.fold AND so_{c}.v = CAST(r.{c} AS VARCHAR)" for c in CATS))
    test = ("SELECT r.id, " + ", ".join(f"{_r(f'sf_{c}.m')} AS loo_{c}" for c in CATS) +
            " FROM (SELECT * FROM policy_folds WHERE fold IS NULL) r " +
            " ".join(f"LEFT JOIN sf_{c} ON sf_{c}.v = CAST(r.{c} AS VARCHAR)" for c in CATS))
    return duck_with(train + " UNION ALL " + test, "policy_folds", extra=extra)


@register("oof_mean", _oof_mean_sql())
def q_oof_mean(spark, sf_dir):
    df = fx.policy_folds(spark, sf_dir)
    out = te.oof_mean(df, CATS)
    return round_doubles(out.select("id", *[f"loo_{c}" for c in CATS]))


# ----------------------------------------------------------- E12-E14
BIN_COLS = ["price", "bal"]


@register("equal_width_bins", duck_with(
    "SELECT id, " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN -1 ELSE CAST(least(greatest(ceil(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / 50)) - 1, 0), 49) AS INT) END "
        f"AS {c}_bin" for c in BIN_COLS) +
    " FROM policy CROSS JOIN (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in BIN_COLS) +
    " FROM policy)", "policy"))
def q_equal_width_bins(spark, sf_dir):
    p = fx.policy(spark, sf_dir).select("id", *BIN_COLS)
    return en.equal_width_bins(p, BIN_COLS, 50).select("id", *[c + "_bin" for c in BIN_COLS])


@register("unpack_int", duck_with("""
SELECT id, CAST(CASE WHEN x = -1 THEN -1 ELSE a END AS INT) AS x_A, CAST(CASE WHEN x = -1 THEN -1 ELSE m END AS INT) AS x_M
FROM (SELECT id, x, CAST(round_even(pow(x * 40, 2), 0) AS BIGINT) AS i FROM packed)
JOIN (SELECT a, m FROM range(1, 32) r(a) CROSS JOIN range(-1, 4000) q(m)) ON 31 * m + a = i""", "packed"))
def q_unpack_int(spark, sf_dir):
    return en.unpack_int(fx.packed(spark, sf_dir), "x").select("id", "x_A", "x_M")


@register("product_feature", duck_with("SELECT id, round(price * bal, 6) AS price_x_bal FROM policy", "policy"))
def q_product_feature(spark, sf_dir):
    p = fx.policy(spark, sf_dir).select("id", "price", "bal")
    return round_doubles(en.product_feature(p, "price", "bal").select("id", "price_x_bal"))


# ----------------------------------------------------------- E17-E20
NONLINEAR_BINDINGS = {
    "ps_ind_03": "CAST(prio_cat AS DOUBLE) / 5",
    "ps_ind_14": "CAST(debt_bin AS DOUBLE)",
    "ps_ind_15": "CAST(month_cat AS DOUBLE) / 12",
    "ps_reg_01": "CAST(price AS DOUBLE) / 500000",
    "ps_reg_02": "CAST(bal AS DOUBLE) / 10000",
    "ps_reg_03": "CAST(age AS DOUBLE) / 100",
    "ps_calc_01": "CAST(calc_01 AS DOUBLE) / 10",
    "ps_calc_13": "CAST(nation_cat AS DOUBLE) / 25",
    "ps_calc_14": "CAST(cust_cat AS DOUBLE) / 1500",
    "ps_car_13": "CAST(price AS DOUBLE) / 250000",
}


def _derive_sql():
    """The 20 formulas written out in SQL (not the operator's dictionary)."""
    base = "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in NONLINEAR_BINDINGS.items()) + " FROM policy"
    one = f"""SELECT *,
  ps_ind_03 + ps_ind_14 + ps_ind_15 * ps_ind_15 AS v001,
  ps_ind_03 + ps_ind_14 + tanh(ps_ind_15) AS v002,
  ps_reg_01 + ps_reg_02 * ps_reg_02 * ps_reg_02 + ps_reg_03 AS v003,
  ps_reg_01 ** 2.15 + tanh(ps_reg_02) + ps_reg_03 ** 3.1 AS v004,
  ps_calc_01 + ps_calc_13 + tanh(ps_calc_14) AS v005,
  ps_ind_03 ** 2.1 + ps_ind_14 ** 0.45 + ps_ind_15 ** 2.4 AS v011,
  ps_ind_03 ** 2.56 + ps_calc_13 ** 2.15 + ps_reg_01 ** 2.3 AS v012 FROM ({base})"""
    two = f"""SELECT *,
  ps_car_13 + tanh(v003) AS v006, ps_car_13 + v002 ** 2.7 AS v007, ps_car_13 + v003 ** 3.4 AS v008,
  ps_car_13 + v004 ** 3.1 AS v009, ps_car_13 + v005 ** 2.3 AS v010,
  v003 ** 2.15 + ps_reg_01 ** 2.49 + ps_ind_15 ** 2.14 AS v013,
  v003 ** 3.21 + 0.001 * tanh(ps_reg_01) + ps_ind_15 ** 3.12 AS v015,
  v012 ** 2.3 + v002 ** 2.3 + v005 ** 2.31 AS v018, v012 ** 2.7 + v002 ** 2.2 + v005 ** 2.43 AS v020 FROM ({one})"""
    three = f"""SELECT *,
  v009 ** 2.36 + ps_calc_01 ** 2.25 + ps_reg_01 ** 2.36 AS v014,
  v009 ** 2.13 + 0.001 * tanh(ps_calc_01) + ps_reg_01 ** 2.13 AS v016,
  v008 ** 2.6 + v009 ** 2.1 + v004 ** 2.13 AS v019 FROM ({two})"""
    four = f"SELECT *, v016 * v016 + v001 ** 2.1 + v003 ** 2.3 AS v017 FROM ({three})"
    names = [f"v{i:03d}" for i in range(1, 21)]
    return duck_with("SELECT id, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + f" FROM ({four})", "policy")


@register("derive_nonlinear", _derive_sql())
def q_derive_nonlinear(spark, sf_dir):
    p = fx.policy(spark, sf_dir)
    base = p.select("id", *[F.expr(e).alias(n) for n, e in NONLINEAR_BINDINGS.items()])
    out = ex.derive(base, ex.NONLINEAR_FORMULAS)
    return round_doubles(out.select("id", *ex.NONLINEAR_FORMULAS))


EXPR_INPUTS = [
    "CAST(price AS DOUBLE) / 500000", "CAST(prio_cat AS DOUBLE) / 5", "CAST(nation_cat AS DOUBLE) / 25",
    "CAST(month_cat AS DOUBLE) / 12", "coalesce(CAST(bal AS DOUBLE), 0) / 10000",
    "coalesce(CAST(age AS DOUBLE), 0) / 100", "CAST(debt_bin AS DOUBLE)", "CAST(calc_01 AS DOUBLE) / 10",
]


def generated_terms(set_idx: int, n_terms: int):
    """A rule-generated term set ``[(name, weight, sql)]`` over the policy inputs
    (stand-in for fitted expression sets, which are data, not code)."""
    m = len(EXPR_INPUTS)
    terms = []
    for j in range(n_terms):
        a, b = (3 * j + set_idx) % m, (5 * j + 1 + set_idx) % m
        c, d = (7 * j + 2) % m, (j + 3 + 2 * set_idx) % m
        w = 0.014245 + 0.00575 * ((37 * j + 11 * set_idx) % 100) / 100.0
        e = f"(({EXPR_INPUTS[a]}) + ({EXPR_INPUTS[b]})) / 2.0 - ({EXPR_INPUTS[c]}) * ({EXPR_INPUTS[d]})"
        terms.append((f"t{j:03d}", w, e))
    return terms


INTERCEPTS = [-0.35, -0.42]


def _sql_term(w, e):
    return f"(CAST({w!r} AS DOUBLE) * tanh({e}))"


def _sql_balanced(parts):
    while len(parts) > 1:
        nxt = [f"({parts[i]} + {parts[i + 1]})" for i in range(0, len(parts) - 1, 2)]
        if len(parts) % 2:
            nxt.append(parts[-1])
        parts = nxt
    return parts[0]


N_TERMS = 400
N_FEATURE_TERMS = N_ENSEMBLE_TERMS = N_TERMS


@register("expr_features", duck_with(
    "SELECT id, " + ", ".join(f"round({_sql_term(w, e)}, 6) AS {n}"
                              for n, w, e in generated_terms(0, N_FEATURE_TERMS)) +
    f', round(CAST({INTERCEPTS[0]!r} AS DOUBLE), 6) AS "0" FROM policy', "policy"))
def q_expr_features(spark, sf_dir):
    """400 weighted terms and the constant column "0"."""
    p = fx.policy(spark, sf_dir, dealt=True)
    return round_doubles(ex.expression_features(p, generated_terms(0, N_FEATURE_TERMS), dealt=True)
                         .withColumn("0", F.lit(INTERCEPTS[0])))


def _ensemble_sql():
    sets = []
    for s in range(2):
        parts = [_sql_term(w, e) for _, w, e in generated_terms(s, N_ENSEMBLE_TERMS)]
        parts.append(f"CAST({INTERCEPTS[s]!r} AS DOUBLE)")
        sets.append(f"(1.0 / (1.0 + exp(-({_sql_balanced(parts)}))))")
    return duck_with(f"SELECT id, round(({sets[0]} + {sets[1]}) / 2.0, 6) AS score FROM policy", "policy")


@register("expr_ensemble", _ensemble_sql())
def q_expr_ensemble(spark, sf_dir):
    p = fx.policy(spark, sf_dir)
    sets = [(generated_terms(s, N_ENSEMBLE_TERMS), INTERCEPTS[s]) for s in range(2)]
    return round_doubles(ex.expression_ensemble(p, sets))


@register("expr_features_sum", duck_with(
    "SELECT id, " + ", ".join(
        f"round({_sql_term(w0, e0)} + {_sql_term(w1, e1)}, 6) AS {n}"
        for (n, w0, e0), (_, w1, e1) in zip(generated_terms(0, N_FEATURE_TERMS), generated_terms(1, N_FEATURE_TERMS)))
    + f', round(CAST({INTERCEPTS[0]!r} AS DOUBLE) + CAST({INTERCEPTS[1]!r} AS DOUBLE), 6) AS "0" FROM policy', "policy"))
def q_expr_features_sum(spark, sf_dir):
    p = fx.policy(spark, sf_dir, dealt=True)
    return round_doubles(ex.expression_features_sum(p, generated_terms(0, N_FEATURE_TERMS),
                                                    generated_terms(1, N_FEATURE_TERMS), dealt=True)
                         .withColumn("0", F.lit(INTERCEPTS[0]) + F.lit(INTERCEPTS[1])))


# ----------------------------------------------------------- E23, E24
_RBF_EXTRA = [
    ("u", "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos "
          "FROM embeddings"),
    ("c", "SELECT label AS center, pos, avg(x) AS cx FROM u GROUP BY label, pos"),
    ("d", "SELECT u.vec_id, c.center, sqrt(sum((u.x - c.cx) * (u.x - c.cx))) AS dist FROM u JOIN c USING (pos) "
          "GROUP BY u.vec_id, c.center"),
    ("rbf", "SELECT vec_id, " + ", ".join(f"max(CASE WHEN center = {j} THEN exp(-1.0 * dist) END) AS rbf_{j}"
                                          for j in range(10)) + " FROM d GROUP BY vec_id"),
]


def _centroid_rbf(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    centers = cl.collect_centers(cl.label_centroids(emb, "embedding", "label"), "label")
    return emb, cl.rbf_features(emb, "embedding", centers, gamma=1.0, keep=["vec_id"])


@register("rbf_features_given_centers", duck_with(
    "SELECT vec_id, " + ", ".join(f"round(rbf_{j}, 6) AS rbf_{j}" for j in range(10)) + " FROM rbf",
    extra=_RBF_EXTRA))
def q_rbf_given(spark, sf_dir):
    return round_doubles(_centroid_rbf(spark, sf_dir)[1])


_OH_POS = [("prio_cat", v) for v in range(1, 6)] + [("month_cat", v) for v in range(1, 13)]


@register("rbf_features_policy", duck_with(
    "SELECT id, " + ", ".join(f"round(exp(-list_distance(v, (SELECT c FROM cen WHERE g = {j}))), 6) AS rbf_{j}"
                              for j in range(25)) + " FROM vec", "policy", extra=[
        ("vec", "SELECT id, nation_cat AS g, [" + ", ".join(f"CAST({c} = {v} AS INT)::DOUBLE" for c, v in _OH_POS) +
         "] AS v FROM policy"),
        ("cen", "SELECT g, [" + ", ".join(f"avg(v[{i + 1}])" for i in range(len(_OH_POS))) + "] AS c FROM vec GROUP BY g")]))
def q_rbf_policy(spark, sf_dir):
    """E23 on one-hot rows, train and test together, with 25 given centers (the means per nation)."""
    p = fx.policy(spark, sf_dir).select("id", "nation_cat", "prio_cat", "month_cat")
    wide = en.one_hot(p, ["prio_cat", "month_cat"])
    vec = wide.select("id", "nation_cat", F.array(*[F.col(f"`{c}_{v}`").cast("double") for c, v in _OH_POS]).alias("v"))
    centers = cl.collect_centers(cl.label_centroids(vec, "v", "nation_cat"), "nation_cat")
    return round_doubles(cl.rbf_features(vec, "v", centers, keep=["id"]))


@register("append_features", duck_with(
    "SELECT e.vec_id, e.label, round(n.norm, 6) AS norm, " + ", ".join(f"round(rbf_{j}, 6) AS rbf_{j}" for j in range(10)) +
    " FROM embeddings e JOIN (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM u GROUP BY vec_id) n USING (vec_id) "
    "JOIN rbf USING (vec_id)", extra=_RBF_EXTRA))
def q_append_features(spark, sf_dir):
    emb, rbf = _centroid_rbf(spark, sf_dir)
    vec = cl.as_double_array("embedding")
    base = emb.select("vec_id", "label",
                      F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x)).alias("norm"))
    return round_doubles(join_feature_table(base, rbf, "vec_id"))


# --------------------------------------------------------- scalar functions
@register("scalar_math", duck_with("""
SELECT id,
  round(price / 2.0 - coalesce(nullif(bal, -1), 0) * 3 + (-coalesce(nullif(age, -1), 0)), 6) AS f_arith,
  round(tanh(price / 100000), 6) AS f_tanh,
  round(pow(coalesce(nullif(age, -1), 0), 2.15), 6) AS f_pow,
  round(1 / (1 + exp(-(price / 100000 - 2))), 6) AS f_sigmoid,
  round(exp(-1.0 * price / 100000), 6) AS f_exp,
  round_even(price / 1000, 0) AS f_round_even,
  CAST(cust_cat % 31 AS BIGINT) AS f_mod,
  CAST(floor(cust_cat / 31) AS BIGINT) AS f_floordiv,
  CAST(price > 250000 AS INT) AS f_flag,
  CAST(bal = -1 AS INT) AS f_is_sentinel,
  CAST(nullif(age, -1) IS NULL AS INT) AS f_is_null,
  round(greatest(least(price / 400000, 1), 0), 6) AS f_clamp
FROM policy_sentinel""", "policy_sentinel"))
def q_scalar_math(spark, sf_dir):
    p = fx.policy(spark, sf_dir, sentinel_null=False)
    bal, age = F.nullif("bal", F.lit(-1)), F.nullif("age", F.lit(-1))
    out = p.select(
        "id",
        (F.col("price") / 2.0 - F.coalesce(bal, F.lit(0)) * 3 + (-F.coalesce(age, F.lit(0)))).alias("f_arith"),
        F.tanh(F.col("price") / 100000).alias("f_tanh"),
        F.pow(F.coalesce(age, F.lit(0)), 2.15).alias("f_pow"),
        ex.sigmoid(F.col("price") / 100000 - 2).alias("f_sigmoid"),
        F.exp(F.lit(-1.0) * F.col("price") / 100000).alias("f_exp"),
        F.bround(F.col("price") / 1000, 0).alias("f_round_even"),
        F.pmod(F.col("cust_cat"), F.lit(31)).cast("bigint").alias("f_mod"),
        F.floor(F.col("cust_cat") / 31).cast("bigint").alias("f_floordiv"),
        fn.flag(F.col("price") > 250000).alias("f_flag"),
        fn.flag(F.col("bal") == -1).alias("f_is_sentinel"),
        fn.flag(age.isNull()).alias("f_is_null"),
        fn.clamp(F.col("price") / 400000, 0.0, 1.0).alias("f_clamp"))
    return round_doubles(out)


@register("string_key", duck_with(
    "SELECT id, CASE WHEN age IS NULL THEN 'nan' ELSE CAST(age AS VARCHAR) END || '_' || CAST(nation_cat AS VARCHAR) AS key, "
    "CAST(nation_cat AS VARCHAR) || '_' || CASE WHEN age IS NULL THEN 'nan' ELSE CAST(age AS VARCHAR) END AS key_back "
    "FROM policy", "policy"))
def q_string_key(spark, sf_dir):
    p = fx.policy(spark, sf_dir)
    return p.select("id", fn.string_key("age", "nation_cat").alias("key"),
                    fn.string_key("nation_cat", "age").alias("key_back"))


@register("add_noise", duck_with("SELECT id, round(price, 6) AS price_noisy FROM policy", "policy"))
def q_add_noise(spark, sf_dir):
    p = fx.policy(spark, sf_dir)
    return round_doubles(p.select("id", fn.add_noise(F.col("price"), 0.0, seed=7).alias("price_noisy")))


# ------------------------------------------------------- folds, resampling
@register("kfold_stratified", duck_with(
    "SELECT id, CAST((row_number() OVER (PARTITION BY target ORDER BY md5('1024:' || CAST(id AS VARCHAR)), id) - 1) % 5 "
    "AS INT) AS fold FROM policy WHERE target IS NOT NULL", "policy"))
def q_kfold_stratified(spark, sf_dir):
    p = fx.policy(spark, sf_dir).filter("target IS NOT NULL")
    return fo.kfold_stratified(p, 5, 1024).select("id", "fold")


@register("kfold_repeated", duck_with(
    "SELECT id, CAST(rep AS INT) AS rep, CAST(CAST(('0x' || substr(md5(CAST(1024 + 11 * rep AS VARCHAR) || ':' || "
    "CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INT) AS fold FROM policy CROSS JOIN range(0, 3) r(rep) "
    "WHERE split = 'train'", "policy"))
def q_kfold_repeated(spark, sf_dir):
    p = fx.policy(spark, sf_dir).filter("split = 'train'")
    return fo.kfold_repeated(p, 3, 5, 1024).select("id", "rep", "fold")


@register("fold_preproc", duck_with(
    "SELECT r.id, CAST(k.k AS INT) AS model_fold, CASE WHEN r.fold = k.k THEN 'valid' ELSE 'train' END AS part, "
    "round((r.price - b.lo) / (b.hi - b.lo), 6) AS price FROM policy_folds r CROSS JOIN range(0, 5) k(k) "
    "JOIN (SELECT k2.k, min(price) AS lo, max(price) AS hi FROM policy_folds t CROSS JOIN range(0, 5) k2(k) "
    "WHERE t.fold IS NOT NULL AND t.fold <> k2.k GROUP BY k2.k) b ON b.k = k.k WHERE r.fold IS NOT NULL",
    "policy_folds"))
def q_fold_preproc(spark, sf_dir):
    df = fx.policy_folds(spark, sf_dir).select("id", "fold", "price")
    out = sc.fold_minmax_scale(df, ["price"], 5)
    return round_doubles(out.select("id", "model_fold", "part", "price"))


@register("fold_preproc_standard", duck_with(
    "SELECT r.id, CAST(k.k AS INT) AS model_fold, CASE WHEN r.fold = k.k THEN 'valid' ELSE 'train' END AS part, "
    "round((coalesce(CAST(r.bal AS DOUBLE), b.mu) - b.mu) / b.sd, 6) AS bal FROM policy_folds r CROSS JOIN range(0, 5) k(k) "
    "JOIN (SELECT k2.k, avg(bal) AS mu, stddev_pop(bal) AS sd FROM policy_folds t CROSS JOIN range(0, 5) k2(k) "
    "WHERE t.fold IS NOT NULL AND t.fold <> k2.k GROUP BY k2.k) b ON b.k = k.k WHERE r.fold IS NOT NULL",
    "policy_folds"))
def q_fold_preproc_standard(spark, sf_dir):
    """X6 with a callback: mean imputation and standard scaling fitted without each fold."""
    df = fx.policy_folds(spark, sf_dir).select("id", "fold", "bal")

    def fit(train):
        return sc.stats_row(train, [F.avg("bal").alias("mu"), F.stddev_pop("bal").alias("sd")])

    def apply(rows, s):
        x = F.coalesce(F.col("bal").cast("double"), sc.stat_lit(s["mu"]))
        return rows.withColumn("bal", (x - sc.stat_lit(s["mu"])) / sc.stat_lit(s["sd"]))

    return round_doubles(sc.fold_apply(df, 5, fit, apply).select("id", "model_fold", "part", "bal"))


@register("seed_schedule", duck_with(
    "SELECT DISTINCT model, fold, bag, 1024 + 17 * fold + 13 * bag AS seed FROM scores WHERE split = 'train'",
    "scores"))
def q_seed_schedule(spark, sf_dir):
    s = fx.scores(spark, sf_dir).filter("split = 'train'").select("model", "fold", "bag").distinct()
    return s.withColumn("seed", fo.seed_schedule(1024, 0, F.col("fold"), F.col("bag")))


@register("union_split", duck_with("SELECT id, target, price, split FROM policy", "policy"))
def q_union_split(spark, sf_dir):
    p = fx.policy(spark, sf_dir)
    train = p.filter("split = 'train'").select("id", "target", "price")
    test = p.filter("split = 'test'").select("id", "price")
    return round_doubles(fo.union_split(train, test))


@register("upsample_positive", duck_with(
    "SELECT id, split, target, 0 AS copy FROM policy UNION ALL "
    "SELECT id, split, target, 1 AS copy FROM policy WHERE split = 'train' AND target = 1", "policy"))
def q_upsample_positive(spark, sf_dir):
    p = fx.policy(spark, sf_dir).select("id", "split", "target")
    return fo.upsample_positive(p)


# ------------------------------------------------------------ M7, M9
_FIN = [("fin", "SELECT id, model, split, avg(pred) AS pred FROM scores GROUP BY id, model, split")]


@register("blend_mean", duck_with("SELECT id, split, round(avg(pred), 6) AS pred FROM fin GROUP BY id, split",
                                  "scores", extra=_FIN))
def q_blend_mean(spark, sf_dir):
    final = pr.final_predictions(fx.scores(spark, sf_dir))
    return round_doubles(final.groupBy("id", "split").agg(F.avg("pred").alias("pred")))


@register("stack_pivot", duck_with(
    "SELECT id, " + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN pred END), 6) AS {m}" for m in fx.SCORE_MODELS) +
    ", split FROM fin GROUP BY id, split", "scores", extra=_FIN))
def q_stack_pivot(spark, sf_dir):
    scores, models = fx.scores(spark, sf_dir), list(fx.SCORE_MODELS)
    wide = [pr.stack_matrix(scores, models, s).withColumn("split", F.lit(s)) for s in ("train", "test")]
    return round_doubles(wide[0].unionByName(wide[1]))
