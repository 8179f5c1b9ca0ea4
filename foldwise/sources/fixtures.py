"""Supervised fixtures derived from the driver's tables, with DuckDB twins.

The driver tables carry no sentinels and no labels, so the ``policy`` view joins
``orders`` with ``customer`` and derives a label, categorical, binary, numeric
and droppable-prefix columns, with ``-1`` sentinels in ``bal`` and ``age``.
Every builder here has a SQL twin in ``DUCK_CTES`` so oracle queries start
from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.hashing import duck_hash_mod, hash_mod
from foldwise.sources.tables import read_table

SPLIT_SEED = 7          # test rows: hash_mod(7, id, 5) == 0
SPLIT_MOD = 5
FOLD_SEED = 1024        # the reference's fold seed
N_FOLDS = 5
SENTINEL = -1

FEATURES = ["prio_cat", "nation_cat", "seg_cat", "cust_cat", "month_cat",
            "debt_bin", "price", "bal", "age", "calc_01"]
NUMERIC_FEATURES = [c for c in FEATURES if c != "seg_cat"]
CAT_FEATURES = [c for c in FEATURES if "_cat" in c]


TASK_ROWS = 100_000     # of a task that makes hundreds of columns: a Parquet writer holds a dictionary of each of them
KEY_BUCKETS = 1 << 12


def _parts(o: DataFrame) -> tuple[int, bool]:
    """(partitions for wide rows of these orders, no customers have so many orders that dealing by customer is uneven)"""
    sizes = o.filter(F.col("o_custkey").isNotNull()).groupBy(F.pmod(F.xxhash64("o_custkey"), F.lit(KEY_BUCKETS))).count()
    total, most = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    parts = max(4 * o.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    return parts, most <= max(TASK_ROWS, 4 * total // KEY_BUCKETS)


def policy_raw(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``dealt``: rows come dealt over all cores, for queries with much work a row (a narrow table has few splits).  The join's
    own shuffle deals them by customer; only where some customers have very many orders a second one deals them evenly."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.month("o_orderdate").alias("o_month"),
        F.substring("o_orderpriority", 1, 1).alias("o_prio"))
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    parts, even = _parts(o) if dealt else (0, True)
    if dealt and even:
        o, c = o.repartition(parts, "o_custkey"), c.repartition(parts, "c_custkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    j = j.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        F.col("o_prio").cast("int").alias("prio_cat"),
        F.col("c_nationkey").alias("nation_cat"),
        F.col("c_mktsegment").alias("seg_cat"),
        F.col("o_custkey").cast("int").alias("cust_cat"),
        F.col("o_month").cast("int").alias("month_cat"),
        (F.col("c_acctbal") < 0).cast("int").alias("debt_bin"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("c_acctbal") < 0, F.lit(-1.0)).otherwise(F.col("c_acctbal")).alias("bal"),
        F.when(F.col("o_custkey") % 7 == 0, F.lit(-1))
         .otherwise((F.col("o_custkey") % 100).cast("int")).alias("age"),
        (F.col("o_orderkey") % 10).alias("calc_01"),
    )
    return j if even else j.repartition(parts)


def label_split(df: DataFrame, seed: int = SPLIT_SEED, mod: int = SPLIT_MOD,
                label: str = "target", id_col: str = "id") -> DataFrame:
    """Add ``split`` ('train'/'test'); the label of test rows becomes NULL."""
    is_test = hash_mod(seed, id_col, mod) == 0
    cols = []
    for c in df.columns:
        if c == label:
            cols.append(F.when(is_test, F.lit(None)).otherwise(F.col(c)).cast("int").alias(c))
            cols.append(F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias("split"))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def sentinel_to_null(df: DataFrame, cols, sentinel=SENTINEL) -> DataFrame:
    cols = set(cols)
    return df.select(*[F.nullif(F.col(c), F.lit(sentinel)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def policy(spark: SparkSession, sf_dir: str, sentinel_null: bool = True, dealt: bool = False) -> DataFrame:
    """Labelled + unlabelled rows in one frame: id, target, split, features."""
    df = label_split(policy_raw(spark, sf_dir, dealt))
    return sentinel_to_null(df, NUMERIC_FEATURES) if sentinel_null else df


def with_folds(df: DataFrame, k: int = N_FOLDS, seed: int = FOLD_SEED,
               id_col: str = "id", split_col: str = "split") -> DataFrame:
    fold = hash_mod(seed, id_col, k).cast("int")
    return df.withColumn("fold", F.when(F.col(split_col) == "train", fold))


def policy_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_folds(policy(spark, sf_dir))


def planted_target(id_col: str = "id") -> F.Column:
    h = hash_mod(9, id_col, 5)
    return F.when(F.col("prio_cat") + F.pmod(F.col("nation_cat"), F.lit(5)) + h > 7, 1).otherwise(0)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``policy`` whose label carries a planted signal (prio_cat + nation_cat % 5 + noise)."""
    raw = policy_raw(spark, sf_dir).withColumn("target", planted_target())
    return with_folds(sentinel_to_null(label_split(raw), NUMERIC_FEATURES))


def features_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external feature table keyed by id (stands in for precomputed feature files)."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") / 1000.0).alias("f1"),
        (F.col("o_custkey") % 13).cast("double").alias("f2"),
        (F.year("o_orderdate") - 1990).cast("double").alias("f3"),
    )


SCORE_MODELS = {
    # name: prediction expression over policy columns
    # divisors with non-terminating quotients keep averages off rounding ties
    "m0": "price / 499979.0",
    "m1": "(prio_cat + pmod(nation_cat, 5)) / CAST(9.7 AS DOUBLE)",
    "m2": "coalesce(bal, 0.0) / 9973.0",
}
N_BAGS = 2


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prediction table ``(id, model, split, fold, bag, pred)``.

    Train rows carry one out-of-fold prediction per bag (fold = own fold);
    test rows one prediction per (fold model, bag).
    """
    base = policy_folds(spark, sf_dir)
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).alias("p0"))
                       for m, e in SCORE_MODELS.items()])
    folds_for_row = F.when(F.col("split") == "train", F.array(F.col("fold"))) \
        .otherwise(F.sequence(F.lit(0), F.lit(N_FOLDS - 1)))
    df = (base.select("id", "split", "fold", F.inline(models))
          .withColumn("fold", F.explode(folds_for_row))
          .withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(N_BAGS - 1)))))
    return df.select("id", "model", "split", "fold", "bag",
                     (F.col("p0") + F.col("fold") * 0.001 + F.col("bag") * 0.0005).alias("pred"))


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy(spark, sf_dir).filter("split = 'train'")
    return p.select("id", F.col("target").alias("y"),
                    (F.floor(F.col("price") / 1000) / 500).alias("pred"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy_raw(spark, sf_dir)
    x = F.when(F.col("age") == -1, F.lit(-1.0)).otherwise(
        F.sqrt(F.col("age") * 31 + F.col("prio_cat")) / 40)
    return p.select("id", x.alias("x"))


# --------------------------------------------------------------------------
# DuckDB twins.  Each entry: name -> (body, dependencies).

_H7 = duck_hash_mod(SPLIT_SEED, "id", SPLIT_MOD)
_NULLIF = ", ".join(f"NULLIF({c}, -1) AS {c}" if c in NUMERIC_FEATURES else c for c in FEATURES)
_RAW_FEATURES = ", ".join(FEATURES)

DUCK_CTES: dict[str, tuple[str, list[str]]] = {
    "policy_raw": ("""
SELECT o.o_orderkey AS id,
       CAST(o.o_orderstatus = 'F' AS INT) AS target,
       CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS prio_cat,
       c.c_nationkey AS nation_cat,
       c.c_mktsegment AS seg_cat,
       CAST(o.o_custkey AS INT) AS cust_cat,
       CAST(month(o.o_orderdate) AS INT) AS month_cat,
       CAST(c.c_acctbal < 0 AS INT) AS debt_bin,
       o.o_totalprice AS price,
       CASE WHEN c.c_acctbal < 0 THEN -1.0 ELSE c.c_acctbal END AS bal,
       CASE WHEN o.o_custkey % 7 = 0 THEN -1 ELSE CAST(o.o_custkey % 100 AS INT) END AS age,
       o.o_orderkey % 10 AS calc_01
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""", []),
    "policy_sentinel": (f"""
SELECT id, CASE WHEN {_H7} = 0 THEN NULL ELSE target END AS target,
       CASE WHEN {_H7} = 0 THEN 'test' ELSE 'train' END AS split, {_RAW_FEATURES}
FROM policy_raw""", ["policy_raw"]),
    "policy": (f"SELECT id, target, split, {_NULLIF} FROM policy_sentinel", ["policy_sentinel"]),
    "policy_folds": (f"""
SELECT *, CASE WHEN split = 'train' THEN CAST({duck_hash_mod(FOLD_SEED, 'id', N_FOLDS)} AS INT) END AS fold
FROM policy""", ["policy"]),
    "planted_raw": (f"""
SELECT * REPLACE (CASE WHEN prio_cat + (nation_cat % 5) + {duck_hash_mod(9, 'id', 5)} > 7 THEN 1 ELSE 0 END AS target)
FROM policy_raw""", ["policy_raw"]),
    "planted": (f"""
SELECT *, CASE WHEN split = 'train' THEN CAST({duck_hash_mod(FOLD_SEED, 'id', N_FOLDS)} AS INT) END AS fold
FROM (SELECT id, CASE WHEN {_H7} = 0 THEN NULL ELSE target END AS target,
             CASE WHEN {_H7} = 0 THEN 'test' ELSE 'train' END AS split, {_NULLIF}
      FROM planted_raw)""", ["planted_raw"]),
    "features_ext": ("""
SELECT o_orderkey AS id, o_totalprice / 1000.0 AS f1, CAST(o_custkey % 13 AS DOUBLE) AS f2,
       CAST(year(o_orderdate) - 1990 AS DOUBLE) AS f3
FROM orders""", []),
    "scores": ("""
SELECT b.id, m.model, b.split, CAST(f.fold AS INT) AS fold, CAST(g.bag AS INT) AS bag,
       CASE m.model WHEN 'm0' THEN b.price / 499979.0
                    WHEN 'm1' THEN (b.prio_cat + (b.nation_cat % 5)) / CAST(9.7 AS DOUBLE)
                    ELSE coalesce(b.bal, 0.0) / 9973.0 END + f.fold * 0.001 + g.bag * 0.0005 AS pred
FROM policy_folds b
CROSS JOIN (VALUES ('m0'), ('m1'), ('m2')) m(model)
JOIN range(0, 5) f(fold) ON (b.split = 'train' AND f.fold = b.fold) OR b.split = 'test'
CROSS JOIN range(0, 2) g(bag)""", ["policy_folds"]),
    "ties": ("""
SELECT id, target AS y, floor(price / 1000) / 500 AS pred FROM policy WHERE split = 'train'""", ["policy"]),
    "packed": ("""
SELECT id, CASE WHEN age = -1 THEN -1.0 ELSE sqrt(age * 31 + prio_cat) / 40 END AS x FROM policy_raw""",
               ["policy_raw"]),
}


def duck_with(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the named fixture CTEs (dependencies first), then ``extra``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in DUCK_CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({DUCK_CTES[n][0].strip()})" for n in order]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in (extra or [])]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
