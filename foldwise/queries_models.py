"""Queries that train models (rows-only checks) plus class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import scalar as fn
from foldwise.functions.hashing import duck_hash_u32
from foldwise.operators import cluster as cl
from foldwise.operators import metrics as me
from foldwise.operators import scale as sc
from foldwise.plans import models as mo
from foldwise.plans import oof as oo
from foldwise.plans import pairwise as pw
from foldwise.plans import stack as sk
from foldwise.plans import sweep as sw
from foldwise.registry import register, round_doubles
from foldwise.session import materialize
from foldwise.sources import fixtures as fx
from foldwise.sources.fixtures import duck_with
from foldwise.sources.tables import read_table

NUMS = ["prio_cat", "nation_cat", "month_cat", "debt_bin", "price", "bal", "age"]
TE = [c for c in fx.FEATURES if "_cat" in c]          # FeatureSpec.te_marker convention


def model_frame(spark, sf_dir, stored=False):
    """Planted fixture, NULLs mean-imputed and numeric columns min-max scaled
    with train statistics.  ``stored`` writes the joined rows once instead of joining them again for every
    statistic (not for MLlib's trees, whose draws follow the splits of the rows)."""
    df = fx.planted(spark, sf_dir)
    if stored:
        df = materialize(df, "planted")
    train = df.filter("split = 'train'")
    df = sc.impute_mean(df, ["bal", "age"], fit=train)
    df = sc.minmax_scale(df, NUMS, fit=df.filter("split = 'train'"))
    return df


def _preds(df):
    return round_doubles(df)


@register("class_weight", duck_with(
    "SELECT id, CASE WHEN target = 1 THEN 1.5 ELSE 1.0 END AS weight FROM policy WHERE split = 'train'", "policy"))
def q_class_weight(spark, sf_dir):
    p = fx.policy(spark, sf_dir).filter("split = 'train'")
    return mo.class_weights(p, "target", 1.5).select("id", "weight")


@register("oof_lr")
def q_oof_lr(spark, sf_dir):
    df = model_frame(spark, sf_dir, stored=True)
    return _preds(oo.oof_train(df, mo.lookup("lr1"), NUMS, te_cols=TE))


@register("oof_gbt")
def q_oof_gbt(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    return _preds(oo.oof_train(df, mo.lookup("gbt_small"), NUMS, te_cols=TE, early_stop=True))


@register("oof_rf")
def q_oof_rf(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    return _preds(oo.oof_train(df, mo.lookup("rf_small"), NUMS, te_cols=TE))


@register("oof_mlp")
def q_oof_mlp(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    spec = mo.lookup("mlp_small")
    spec = mo.ModelSpec(spec.name, spec.mdl_type, {**spec.param, "n_features": len(NUMS) + len(TE)})
    return _preds(oo.oof_train(df, spec, NUMS, te_cols=TE))


@register("oof_scores")
def q_oof_scores(spark, sf_dir):
    df = model_frame(spark, sf_dir, stored=True)
    preds = oo.oof_train(df, mo.lookup("lr1"), NUMS, te_cols=TE)
    return round_doubles(me.cv_summary(preds, df.select("id", "target"), by=["model", "bag"]))


@register("oof_bagged")
def q_oof_bagged(spark, sf_dir):
    df = model_frame(spark, sf_dir, stored=True)
    preds = oo.oof_train(df, mo.lookup("lr2"), NUMS, te_cols=TE, bags=2, refold_per_bag=True)
    return _preds(preds)


@register("oof_upsampled")
def q_oof_upsampled(spark, sf_dir):
    df = model_frame(spark, sf_dir, stored=True)
    return _preds(oo.oof_train(df, mo.lookup("lr1"), NUMS, te_cols=TE, upsample=True))


@register("learning_curve")
def q_learning_curve(spark, sf_dir):
    """Gini of every fold model after each stage, on its train and its held-out rows."""
    df = model_frame(spark, sf_dir)
    return round_doubles(oo.learning_curve(df, mo.lookup("newton_small"), NUMS))


@register("shadow_importance")
def q_shadow_importance(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    return round_doubles(oo.shadow_importance(df, mo.lookup("rf_small"), NUMS))


def _level1(spark, sf_dir):
    return fx.scores(spark, sf_dir), fx.policy(spark, sf_dir).select("id", "target"), list(fx.SCORE_MODELS)


@register("stack_l2")
def q_stack_l2(spark, sf_dir):
    preds, labels, models = _level1(spark, sf_dir)
    return _preds(sk.stack_level(preds, labels, models, mo.lookup("stack_lr1")))


@register("stack_linear")
def q_stack_linear(spark, sf_dir):
    preds, labels, models = _level1(spark, sf_dir)
    return _preds(sk.stack_level(preds, labels, models, mo.lookup("xgbl")))


@register("stack_l3")
def q_stack_l3(spark, sf_dir):
    preds, labels, models = _level1(spark, sf_dir)
    l2 = sk.stack_level(preds, labels, models, mo.lookup("stack_lr1")) \
        .unionByName(sk.stack_level(preds, labels, models, mo.lookup("xgbl")))
    return _preds(sk.stack_level(l2, labels, ["stack_lr1", "xgbl"], mo.lookup("stack_lr2")))


@register("model_registry")
def q_model_registry(spark, sf_dir):
    df = model_frame(spark, sf_dir, stored=True)
    spec = mo.lookup("lr2")
    preds = oo.oof_train(df, spec, NUMS, te_cols=TE, bags=spec.bag, splits=spec.split, k=spec.fold)
    summ = me.cv_summary(preds, df.select("id", "target"), by=["model"])
    return round_doubles(summ.withColumn("mdl_type", F.lit(spec.mdl_type))
                         .withColumn("dropped", F.lit(" ".join(mo.dropped_params(spec)))))


SWEEP_BOX = {"regParam": (1e-4, 1e-1, "log"), "elasticNetParam": (0.0, 1.0, "lin"), "maxIter": (20, 60, "int")}


@register("param_sweep")
def q_param_sweep(spark, sf_dir):
    from pyspark.ml.classification import LogisticRegression
    df = model_frame(spark, sf_dir, stored=True)
    pts = [sw.param_sanitise(p, int_params=["maxIter"], unit_params=["elasticNetParam"])
           for p in sw.param_grid(SWEEP_BOX, 8, seed=1024)]
    return round_doubles(sw.param_sweep(df, LogisticRegression(standardization=True), pts, NUMS))


@register("rbf_features")
def q_rbf_features(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    centers = cl.kmeans_centers(emb, "embedding", k=25, seed=1)
    return round_doubles(cl.rbf_features(emb, "embedding", centers, gamma=1.0, keep=["vec_id"]))


@register("add_noise_level", duck_with(
    "SELECT id, round(price * (1.0 + CAST(0.01 AS DOUBLE) * (sqrt(-2.0 * ln((" + duck_hash_u32("7a", "id") +
    " + 1) / 4294967297.0)) * cos(2.0 * pi() * (" + duck_hash_u32("7b", "id") + " / 4294967296.0)))), 6) AS price_noisy "
    "FROM policy", "policy"))
def q_add_noise_level(spark, sf_dir):
    p = fx.policy(spark, sf_dir)
    return round_doubles(p.select("id", fn.add_noise(F.col("price"), 0.01, seed=7).alias("price_noisy")))


@register("oof_bagged_seeds")
def q_oof_bagged_seeds(spark, sf_dir):
    """Bags share the folds; the learner seed moves by 100 per bag."""
    df = model_frame(spark, sf_dir)
    return _preds(oo.oof_train(df, mo.lookup("rf_small"), NUMS, te_cols=TE, bags=2, bag_seed_step=100))


@register("oof_repeated")
def q_oof_repeated(spark, sf_dir):
    """X5 under X8: two independent splits, their predictions side by side (``rep``)."""
    df = model_frame(spark, sf_dir, stored=True)
    return _preds(oo.oof_train(df, mo.lookup("lr1"), NUMS, te_cols=TE, splits=2))


@register("oof_stratified")
def q_oof_stratified(spark, sf_dir):
    """X4 under X8: stratified folds."""
    df = model_frame(spark, sf_dir, stored=True)
    return _preds(oo.oof_train(df, mo.lookup("lr1"), NUMS, stratified=True))


# ------------------------------------------------------------------ twins
# Who is predicted, by which fold model, and that every prediction is a probability: the part
# of a training query that SQL can state.  The full predictions are the queries above.
_FOLD = "CAST(CAST(('0x' || substr(md5('{seed}:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INT)"


def _shape_sql(model: str, bags: int = 1, refold: bool = False, reps: int = 1) -> str:
    parts = []
    for r in range(reps):
        for b in range(bags):
            fold = _FOLD.format(seed=1024 + 11 * r + (10 * b if refold else 0))
            rep = f", CAST({r} AS INT) AS rep" if reps > 1 else ""
            tail = f"CAST({b} AS INT) AS bag{rep}, 1 AS in_range"
            parts.append(f"SELECT id, '{model}' AS model, split, {fold} AS fold, {tail} FROM policy WHERE split = 'train'")
            parts.append(f"SELECT id, '{model}' AS model, split, CAST(j AS INT) AS fold, {tail} FROM policy "
                         "CROSS JOIN range(0, 5) r(j) WHERE split = 'test'")
    return duck_with(" UNION ALL ".join(parts), "policy")


def _shape(preds):
    ok = F.coalesce((F.col("pred") >= 0) & (F.col("pred") <= 1), F.lit(False)).cast("int")
    return preds.withColumn("in_range", ok).drop("pred")


def _register_shapes():
    """``<query>_rows`` for the training queries over the planted fixture."""
    from foldwise.registry import QUERIES
    for name, model, kw in [
            ("oof_lr", "lr1", {}), ("oof_gbt", "gbt_small", {}), ("oof_rf", "rf_small", {}), ("oof_mlp", "mlp_small", {}),
            ("oof_bagged", "lr2", {"bags": 2, "refold": True}), ("oof_upsampled", "lr1", {}),
            ("oof_bagged_seeds", "rf_small", {"bags": 2}), ("oof_repeated", "lr1", {"reps": 2}),
            ("stack_l2", "stack_lr1", {}), ("stack_linear", "xgbl", {}), ("stack_l3", "stack_lr2", {})]:
        def run(spark, sf_dir, name=name):
            return _shape(QUERIES[name](spark, sf_dir))
        register(f"{name}_rows", _shape_sql(model, **kw))(run)


_register_shapes()


@register("oof_tree_means", duck_with(
    "SELECT r.id, r.split, CAST(k.j AS INT) AS fold, round(m.mean, 6) AS pred FROM policy_folds r CROSS JOIN range(0, 5) k(j) "
    "JOIN (SELECT ks.k, prio_cat, avg(CAST(target AS DOUBLE)) AS mean FROM policy_folds t CROSS JOIN range(0, 5) ks(k) "
    "WHERE t.fold IS NOT NULL AND t.fold <> ks.k GROUP BY ks.k, prio_cat) m ON m.k = k.j AND m.prio_cat = r.prio_cat "
    "WHERE r.fold = k.j OR r.split = 'test'", "policy_folds"))
def q_oof_tree_means(spark, sf_dir):
    """A regression tree on a column of five values predicts the mean label of the value over the
    other folds: the whole out-of-fold plan against SQL."""
    return round_doubles(oo.oof_tree(fx.policy_folds(spark, sf_dir), "prio_cat").select("id", "split", "fold", "pred"))


# One depth-2 tree of every fold model, from its definition: all cuts of all columns, L1, L2 and minimum gain.
_T = {"alpha": 2.0, "lambda": 1.5, "gamma": 0.5, "eta": 0.3, "least": 5.0}
_TREE_COLS = ["prio_cat", "month_cat", "nation_cat"]


def _score_sql(n: str, s: str) -> str:
    """Score of a leaf of n rows, s of them positive, at margin 0: gradient sum n / 2 - s, hessian sum n / 4."""
    t = f"greatest(abs(0.5 * {n} - {s}) - {_T['alpha']}, 0.0)"
    return f"({t} * {t} / (0.25 * {n} + {_T['lambda']}))"


def _level_sql(level: int) -> list[tuple[str, str]]:
    """CTEs ``best{level}`` (model, node -> column, cut) and ``n{level}`` (rows with their node after it)."""
    src = f"n{level - 1}"
    cols = "[" + ", ".join(_TREE_COLS) + "]"
    gain = f"{_score_sql('nl', 'sl')} + {_score_sql('nr', 'sr')} - {_score_sql('nt', 'st')} - {_T['gamma']}"
    picked = "CASE fi " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_TREE_COLS)) + " END"
    return [
        (f"h{level}", f"SELECT j, node, fi, v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s FROM (SELECT j, node, y, "
                      f"unnest(range(0, {len(_TREE_COLS)})) AS fi, unnest({cols}) AS v FROM {src} WHERE fold <> j) GROUP BY ALL"),
        (f"cum{level}", f"SELECT j, node, fi, v, nl, sl, nt, st, nt - nl AS nr, st - sl AS sr FROM (SELECT j, node, fi, v, "
                        f"sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER t AS nt, sum(s) OVER t AS st FROM h{level} "
                        f"WINDOW w AS (PARTITION BY j, node, fi ORDER BY v), t AS (PARTITION BY j, node, fi))"),
        (f"best{level}", f"SELECT j, node, fi, v FROM (SELECT *, {gain} AS gain FROM cum{level} WHERE nr > 0 AND 0.25 * nl >= {_T['least']} "
                         f"AND 0.25 * nr >= {_T['least']}) WHERE gain > 1e-12 "
                         f"QUALIFY row_number() OVER (PARTITION BY j, node ORDER BY gain DESC, fi, v) = 1"),
        (f"n{level}", f"SELECT r.* REPLACE (CASE WHEN b.fi IS NULL THEN r.node || '-' WHEN {picked} <= b.v THEN r.node || 'l' "
                      f"ELSE r.node || 'r' END AS node) FROM {src} r LEFT JOIN best{level} b ON b.j = r.j AND b.node = r.node"),
    ]


_TREE_CTES = [("n0", "SELECT id, split, fold, CAST(target AS DOUBLE) AS y, CAST(k.j AS INT) AS j, '' AS node, "
                     + ", ".join(_TREE_COLS) + " FROM planted CROSS JOIN range(0, 5) k(j)"),
              *_level_sql(1), *_level_sql(2),
              ("leaf", f"SELECT j, node, -sign(g) * greatest(abs(g) - {_T['alpha']}, 0.0) / (h + {_T['lambda']}) * {_T['eta']} AS value "
                       "FROM (SELECT j, node, 0.5 * count(*) - sum(y) AS g, 0.25 * count(*) AS h FROM n2 WHERE fold <> j GROUP BY j, node)")]


@register("oof_newton_trees", duck_with(
    "SELECT r.id, r.split, r.j AS fold, round(1.0 / (1.0 + exp(-l.value)), 6) AS pred FROM n2 r JOIN leaf l ON l.j = r.j AND l.node = r.node "
    "WHERE r.fold = r.j OR r.split = 'test'", "planted", extra=_TREE_CTES))
def q_oof_newton_trees(spark, sf_dir):
    """One second-order tree of depth 2 through the whole out-of-fold plan."""
    spec = mo.ModelSpec("newton2", "newton", {
        "learning_rate": _T["eta"], "n_estimators": 1, "max_depth": 2, "reg_alpha": _T["alpha"], "reg_lambda": _T["lambda"],
        "gamma": _T["gamma"], "min_child_weight": _T["least"]})
    preds = oo.oof_train(fx.planted(spark, sf_dir), spec, _TREE_COLS)
    return round_doubles(preds.select("id", "split", "fold", "pred"))


@register("oof_newton")
def q_oof_newton(spark, sf_dir):
    """M1: boosted second-order trees by level, with target encodings and stopping on the held-out Gini."""
    df = model_frame(spark, sf_dir)
    return _preds(oo.oof_train(df, mo.lookup("newton_small"), NUMS, te_cols=TE, early_stop=5))


@register("oof_leafwise")
def q_oof_leafwise(spark, sf_dir):
    """M1: boosted trees grown best-first to a number of leaves."""
    return _preds(oo.oof_train(model_frame(spark, sf_dir), mo.lookup("leafwise_small"), NUMS))


@register("oof_pairwise")
def q_oof_pairwise(spark, sf_dir):
    """M1, 2.12: boosted trees on the pairwise ranking objective."""
    return _preds(oo.oof_train(model_frame(spark, sf_dir), mo.lookup("pairwise_small"), NUMS))


@register("oof_corrective_forest")
def q_oof_corrective_forest(spark, sf_dir):
    """M5: forest of 60 leaves, all weights corrected after every 20 new ones."""
    return _preds(oo.oof_train(model_frame(spark, sf_dir), mo.lookup("forest_small"), NUMS))


_RIDGE = {"l2": 0.02, "sl2": 1e-6}


@register("oof_corrective_means", duck_with(
    "SELECT r.id, r.split, CAST(m.j AS INT) AS fold, round(1.0 / (1.0 + exp(-m.weight)), 6) AS pred FROM planted r "
    "JOIN (SELECT j, prio_cat, sum(2.0 * target - 1.0) / (count(*) + " + str(_RIDGE["l2"]) + " * sum(count(*)) OVER (PARTITION BY j)) AS weight "
    "FROM planted CROSS JOIN range(0, 5) k(j) WHERE fold <> j GROUP BY j, prio_cat) m "
    "ON m.prio_cat = r.prio_cat AND (r.fold = m.j OR r.split = 'test')", "planted"))
def q_oof_corrective_means(spark, sf_dir):
    """M5: one tree with a leaf per value; the ridge solution shrinks every mean by the penalty."""
    spec = mo.ModelSpec("ridge", "forest", {"loss": "LS", "max_leaf": 5, "tree_leaves": 5, "opt_interval": 5, "n_iter": 1,
                                            "learning_rate": 1.0, "min_samples_leaf": 1, **_RIDGE})
    preds = oo.oof_train(fx.planted(spark, sf_dir), spec, ["prio_cat"])
    return round_doubles(preds.select("id", "split", "fold", "pred"))


_PAIR_SCORE = "(prio_cat * 25 + nation_cat) / 40.0"


@register("pair_gradients", duck_with(
    "SELECT r.id, r.fold, round(CASE WHEN r.target = 1 THEN -a.above_n ELSE a.below_p END * t.norm, 6) AS g, "
    "round(CASE WHEN r.target = 1 THEN a.curve_n ELSE a.curve_p END * t.norm, 6) AS h "
    "FROM rows_ r JOIN pairs a ON a.fold = r.fold AND a.score = r.score "
    "JOIN (SELECT fold, (sum(p) + sum(n)) / (sum(p) * sum(n)) AS norm FROM classes GROUP BY fold) t ON t.fold = r.fold",
    "planted", extra=[
        ("rows_", f"SELECT id, fold, target, CAST({_PAIR_SCORE} AS DOUBLE) AS score FROM planted WHERE split = 'train'"),
        ("classes", "SELECT fold, score, CAST(sum(target) AS DOUBLE) AS p, CAST(sum(1 - target) AS DOUBLE) AS n FROM rows_ GROUP BY fold, score"),
        ("pairs", "SELECT x.fold, x.score, sum(y.n * s) AS above_n, sum(y.n * s * (1 - s)) AS curve_n, sum(y.p * (1 - s)) AS below_p, "
                  "sum(y.p * s * (1 - s)) AS curve_p FROM (SELECT a.fold, a.score, b.score AS other, "
                  "1.0 / (1.0 + exp(a.score - b.score)) AS s FROM classes a JOIN classes b ON a.fold = b.fold) x "
                  "JOIN classes y ON y.fold = x.fold AND y.score = x.other GROUP BY x.fold, x.score")]))
def q_pair_gradients(spark, sf_dir):
    """2.12 ``rk``: gradients of the ranking loss over all pairs of each fold."""
    rows = fx.planted(spark, sf_dir).filter("split = 'train'").withColumn("score", F.expr(_PAIR_SCORE).cast("double"))
    return round_doubles(pw.pair_gradients(rows, "target", "score", by=["fold"]).select("id", "fold", "g", "h"))


# A saturated model (one 0/1 column per value, no penalty) predicts the weighted mean label of a value over the
# other folds: a closed form for the whole out-of-fold plan, its folds, bags, splits and weights.
_MEAN_COLS = [f"prio_{v}" for v in range(1, 6)]


def _means_sql(weight: float = 1.0, bags: int = 1, refold: bool = False, reps: int = 1, stratified: bool = False) -> str:
    parts = []
    for r in range(reps):
        for b in range(bags):
            seed = 1024 + 11 * r + (10 * b if refold else 0)
            fold = _FOLD.format(seed=seed) if not stratified else (
                "CAST((row_number() OVER (PARTITION BY split, target "
                f"ORDER BY md5('{seed}:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS INT)")
            parts.append(f"SELECT id, split, target, prio_cat, {r} AS rep, {b} AS bag, "
                         f"CASE WHEN split = 'train' THEN {fold} END AS fold FROM planted")
    return duck_with(
        "SELECT r.id, r.split, CAST(m.j AS INT) AS fold, CAST(r.bag AS INT) AS bag, CAST(r.rep AS INT) AS rep, round(m.mean, 6) AS pred "
        f"FROM rows_ r JOIN (SELECT rep, bag, j, prio_cat, {weight} * sum(target) / ({weight} * sum(target) + count(*) - sum(target)) AS mean "
        "FROM rows_ CROSS JOIN range(0, 5) k(j) WHERE fold <> j GROUP BY rep, bag, j, prio_cat) m "
        "ON m.rep = r.rep AND m.bag = r.bag AND m.prio_cat = r.prio_cat AND (r.fold = m.j OR r.split = 'test')",
        "planted", extra=[("rows_", " UNION ALL ".join(parts))])


def _saturated(spark, sf_dir, **kw):
    df = fx.planted(spark, sf_dir).select(
        "id", "split", "target", "fold", *[(F.col("prio_cat") == v).cast("int").alias(f"prio_{v}") for v in range(1, 6)])
    spec = mo.ModelSpec("saturated", "linear", {"alpha": 0.0, "lambda": 0.0})
    preds = oo.oof_train(df, spec, _MEAN_COLS, **kw)
    preds = preds if "rep" in preds.columns else preds.withColumn("rep", F.lit(0))
    return round_doubles(preds.select("id", "split", "fold", "bag", "rep", "pred"))


def _register_means():
    """X8 plain, X9 folds per bag, X10 bags on shared folds, X5 repeated splits, X4 stratified, X11 upsampled, M6 weighted."""
    for name, sql, kw in [
            ("oof_means", {}, {}),
            ("oof_means_refolded", {"weight": 1.7, "bags": 2, "refold": True}, {"pos_weight": 1.7, "bags": 2, "refold_per_bag": True}),
            ("oof_means_bagged", {"bags": 2}, {"bags": 2}),
            ("oof_means_repeated", {"reps": 2}, {"splits": 2}),
            ("oof_means_stratified", {"stratified": True}, {"stratified": True}),
            ("oof_means_upsampled", {"weight": 2.0}, {"upsample": True}),
            ("oof_means_weighted", {"weight": 1.6}, {"pos_weight": 1.6})]:
        def run(spark, sf_dir, kw=kw):
            return _saturated(spark, sf_dir, **kw)
        register(name, _means_sql(**sql))(run)


_register_means()


@register("kmeans_planted", duck_with(
    "SELECT c_custkey AS id, " + ", ".join(
        f"round(exp(-1.0 * sqrt(pow(x - (SELECT avg(x) FROM pts WHERE g = {j}), 2) + "
        f"pow(y - (SELECT avg(y) FROM pts WHERE g = {j}), 2)) / 1000.0), 6) AS rbf_{j}" for j in range(5)) +
    " FROM pts", extra=[("pts", "SELECT c_custkey, CAST(floor(c_nationkey / 5) AS INT) AS g, "
                                "CAST(floor(c_nationkey / 5) AS DOUBLE) * 10000 + c_custkey % 7 AS x, "
                                "CAST(c_custkey % 11 AS DOUBLE) AS y FROM customer")]))
def q_kmeans_planted(spark, sf_dir):
    """Five well-separated groups of points: the fitted centers are the group means."""
    c = read_table(spark, sf_dir, "customer")
    pts = c.select(F.col("c_custkey").alias("id"),
                   F.array(F.floor(F.col("c_nationkey") / 5).cast("double") * 10000 + F.col("c_custkey") % 7,
                           (F.col("c_custkey") % 11).cast("double")).alias("v"))
    centers = sorted(c for _, c in cl.kmeans_centers(pts, "v", k=5, seed=1, starts=5))
    return round_doubles(cl.rbf_features(pts, "v", list(enumerate(centers)), gamma=1.0 / 1000.0, keep=["id"]))
