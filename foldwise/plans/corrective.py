"""Regularised forest with fully corrective leaf weights, all fold models at once.

A forest is one linear model over the memberships of rows in leaves: its margin is the sum of the weights
of the leaves a row falls into.  Trees grow best-first by second-order gain at the present margins
(plans/boost.py).  After every ``opt_interval`` new leaves the weights of **all** leaves are corrected:

    sum of w * loss + n * l2 / 2 * sum of (leaf weight)^2        (n: weight of the model's rows)

* Rows are stored with the numbers of their leaves, one per tree and model (two bytes each), and written
  anew once per correction.
* The curvature of the logistic loss is at most 1/4, so ``1/4 * M' W M`` (M: memberships) bounds it for
  good.  That matrix does not depend on the weights: a correction adds only the strip of its new leaves,
  summed in one job, and every further round is one job that returns a gradient of one number a leaf.
  Each step minimises an upper bound of the objective, so the objective never rises.  For the squared loss
  the bound is exact and one full step (``learning_rate`` 1) is the ridge solution.
* Sums are exact integers of a scale that follows from the rows, so a forest does not depend on
  partitions or retries.
* The driver holds k x leaves^2 numbers and tasks return new leaves x leaves: bounded by ``MAX_LEAVES``,
  whatever the number of rows.

Edge cases: NULL inputs have a bin of their own; a model without rows, or without any split that gains, has one
leaf (so has each tree of a model that cannot split while others can); constant columns are never split; equal gains go to the first column and cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.plans.boost import Boosted, BoostParams, Growth, Tree, _binned, _cells, _grow, _matrix, _Store, quantile_edges
from foldwise.session import default_buckets

MAX_LEAVES = 2_000           # of one forest: 32 MB of curvature per model on the driver
CURVATURE = {"Log": 0.25, "LS": 1.0}
# settings that must have this value, and names that change no model
FIXED = {"algorithm": "RGF", "calc_prob": "sigmoid", "normalize": False}
IGNORED = {"n_jobs", "verbose", "memory_policy", "seed"}


@dataclass(frozen=True)
class ForestParams:
    max_leaf: int = 1000
    tree_leaves: int = 10                # leaves a tree grows to before the next one starts
    opt_interval: int = 100
    n_iter: int | None = None            # rounds of a correction; None: 10 for LS, 5 for Log
    loss: str = "Log"
    l2: float = 0.1
    sl2: float | None = None             # penalty while trees grow; None: l2
    learning_rate: float = 0.5
    min_samples_leaf: int = 10
    max_bin: int = 255
    scale_pos_weight: float = 1.0

    @classmethod
    def of(cls, param: dict) -> ForestParams:
        """From a spec's parameters; an unknown name or an unsupported value raises."""
        for name, value in FIXED.items():
            if param.get(name, value) != value:
                raise ValueError(f"{name} {param[name]!r} is not supported")
        named = {k: v for k, v in param.items() if k not in IGNORED and k not in FIXED}
        unknown = sorted(named.keys() - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown parameters of a corrective forest: {unknown}")
        out = cls(**named)
        if out.loss not in CURVATURE:
            raise ValueError(f"unknown loss {out.loss!r}")
        if not 2 <= out.max_leaf <= MAX_LEAVES:
            raise ValueError(f"max_leaf must lie between 2 and {MAX_LEAVES}")
        return out

    def rounds(self) -> int:
        return self.n_iter if self.n_iter is not None else 10 if self.loss == "LS" else 5


def _members(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """(rows, models, stored trees): leaf numbers."""
    flat = _matrix(batch.column("leaves"), np.uint16)
    return flat.reshape(batch.num_rows, k, flat.shape[1] // k if batch.num_rows else 0).astype(np.int64)


def _numbers(tree: Tree, start: int) -> np.ndarray:
    """node -> number of its leaf, from ``start``; -1 for inner nodes."""
    leaf = np.array(tree.feature) < 0
    return np.where(leaf, start + np.cumsum(leaf) - 1, -1)


class ForestGrowth(Growth):
    """Growth whose margins come from leaf numbers and the present weights."""

    def __init__(self, params: BoostParams, places: list[list[int]], bins: int, scale: float, loss: str):
        super().__init__(params, places, bins, scale)
        self.loss = loss
        self.weights = [np.zeros(0) for _ in places]
        self.firsts: list[list[int]] = [[] for _ in places]       # number of the first leaf of every stored tree

    def stored_margins(self, members: np.ndarray) -> np.ndarray:
        out = np.zeros(members.shape[:2])
        for j, weights in enumerate(self.weights):
            if members.shape[2]:
                out[:, j] = weights[members[:, j]].sum(axis=1)
        return out

    def margins_of(self, batch: pa.RecordBatch, bins: np.ndarray) -> np.ndarray:
        return self.margins(bins, self.stored_margins(_members(batch, len(self.places))))

    def row_weights(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return w * np.where(y == 1, self.params.scale_pos_weight, 1.0)

    def gradients(self, j: int, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.loss == "Log":
            return super().gradients(j, y, w, margin)
        weight = self.row_weights(y, w)
        return (margin - (2.0 * y - 1.0)) * weight, weight

    def with_new_leaves(self, rows: DataFrame) -> DataFrame:
        """Rows with the leaf numbers of the recent trees behind those they have."""
        numbers = []
        for weights, trees in zip(self.weights, self.recent):
            at, own = len(weights), []
            for tree in trees:
                own.append(_numbers(tree, at))
                at = int(own[-1].max()) + 1
            numbers.append(own)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _matrix(batch.column("bins"), np.uint16)
                old = _members(batch, len(self.places))
                new = np.zeros((len(bins), len(self.places), len(self.recent[0])), np.int64)
                for j, trees in enumerate(self.recent):
                    own = bins[:, self.places[j]]
                    for t, tree in enumerate(trees):
                        new[:, j, t] = numbers[j][t][tree.leaf_of(own)]
                both = np.concatenate([old, new], axis=2).astype(np.uint16).reshape(len(bins), -1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _cells(both)],
                                                 batch.schema.names)

        return rows.mapInArrow(work, rows.schema)

    def leaf_sums(self, rows: DataFrame, starts: list[int] | None) -> list[tuple[np.ndarray | None, np.ndarray]]:
        """Per model the gradient of every leaf and, with ``starts``, the strip (leaves from ``starts`` on) x
        (all leaves) of ``M' W M``; one job."""
        k, sizes = len(self.places), [len(w) for w in self.weights]
        tall = [s - starts[j] if starts else 0 for j, s in enumerate(sizes)]
        offsets = np.concatenate([[0], np.cumsum([s * (t + 1) for s, t in zip(sizes, tall)])])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(offsets[-1], np.int64)
            for batch in batches:
                part, y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "y", "w"))
                members = _members(batch, k)
                margins = self.stored_margins(members)
                for j, size in enumerate(sizes):
                    use = np.flatnonzero((part >= 0) & (part != j))
                    own, into = members[use, j], total[offsets[j]:offsets[j + 1]]
                    g = np.rint(self.gradients(j, y[use], w[use], margins[use, j])[0] * self.scale)
                    weight = np.rint(self.row_weights(y[use], w[use]) * self.scale)
                    for t in range(own.shape[1]):
                        into[:size] += np.bincount(own[:, t], g, size).astype(np.int64)
                    if not tall[j]:
                        continue
                    strip = into[size:].reshape(tall[j], size)
                    trees = [slice(*b) for b in zip(self.firsts[j], [*self.firsts[j][1:], size])]
                    for t, a in enumerate(trees):
                        if a.start < starts[j]:
                            continue
                        for s, b in enumerate(trees):
                            shape = a.stop - a.start, b.stop - b.start
                            cell = (own[:, t] - a.start) * shape[1] + own[:, s] - b.start
                            found = np.bincount(cell, weight, shape[0] * shape[1]).astype(np.int64).reshape(shape)
                            strip[a.start - starts[j]:a.stop - starts[j], b] += found
            some = np.flatnonzero(total)
            for first in range(0, len(some), 1 << 16):
                at = some[first:first + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"cell": at, "value": total[at]})

        found = rows.mapInArrow(work, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(offsets[-1])
        flat[found["cell"].to_numpy()] = found["value"].to_numpy() / self.scale
        out = []
        for j, (size, t) in enumerate(zip(sizes, tall)):
            own = flat[offsets[j]:offsets[j + 1]]
            out.append((own[size:].reshape(t, size) if starts else None, own[:size]))
        return out


def fit_forest(df: DataFrame, columns: Sequence[Sequence[str]], params: ForestParams, label: str = "target",
               fold_col: str = "fold", id_col: str = "id", weight_col: str | None = None) -> Boosted:
    """Model j of ``len(columns)`` learns from the rows whose fold is neither NULL nor j, on ``columns[j]``.

    The result holds the trees with their corrected weights: ``predict_boosted`` scores it."""
    spark, k = df.sparkSession, len(columns)
    physical = list(dict.fromkeys(c for own in columns for c in own))
    labelled = df.filter(F.col(fold_col).isNotNull())
    edges = quantile_edges(labelled, physical, params.max_bin)
    store = _Store(spark)
    binned = _binned(labelled, physical, edges, 0, id_col, label, fold_col, weight_col).withColumnRenamed("margins", "leaves")
    rows = store.put(binned.repartition(default_buckets(spark), "draw"))
    weight = F.col("w") * F.when(F.col("y") == 1, F.lit(float(params.scale_pos_weight))).otherwise(F.lit(1.0))
    units = F.round(weight * float(1 << 20)).cast("long")
    sizes = {r["part"]: r for r in rows.groupBy("part").agg(F.sum(units).alias("n"), F.count(F.lit(1)).alias("rows"),
                                                            F.max(weight).alias("most")).collect()}
    n = [sum(r["n"] for part, r in sizes.items() if part != j) / (1 << 20) for j in range(k)]
    most = max(1.0, sum(r["rows"] for r in sizes.values()) * max([1.0, *(r["most"] for r in sizes.values())]))
    scale = 2.0 ** min(30, 58 - math.ceil(math.log2(most)))          # margins of the squared loss have room for three bits
    search = params.l2 if params.sl2 is None else params.sl2
    grow = BoostParams(learning_rate=params.learning_rate, n_estimators=params.max_leaf, max_depth=0, num_leaves=params.tree_leaves,
                       max_bin=params.max_bin, reg_lambda=search * sum(n) / max(k, 1), min_child_weight=0.0,
                       min_child_samples=params.min_samples_leaf, scale_pos_weight=params.scale_pos_weight)
    places = [[physical.index(c) for c in own] for own in columns]
    growth = ForestGrowth(grow, places, 2 + max((len(e) for e in edges.values()), default=0), scale, params.loss)
    trees: list[list[Tree]] = [[] for _ in range(k)]
    curvature = [np.zeros((0, 0)) for _ in range(k)]
    models, leaves, growing = list(range(k)), [0] * k, True
    while growing:
        room = params.max_leaf - max(leaves)
        growth.params = replace(grow, num_leaves=min(params.tree_leaves, room))
        _grow(growth, rows, models)
        growth.turn += 1
        new = [sum(f < 0 for f in growth.recent[j][-1].feature) for j in models]
        leaves = [a + b for a, b in zip(leaves, new)]
        if max(new, default=0) == 1 and len(trees[0]) + len(growth.recent[0]) > 1:      # nothing gains: the trees so far are the forest
            growth.recent = [own[:-1] for own in growth.recent]
            leaves = [a - 1 for a in leaves]
        growing = max(new, default=0) > 1 and params.max_leaf - max(leaves) >= 2
        fresh = max(a - len(w) for a, w in zip(leaves, growth.weights))
        if growing and fresh < params.opt_interval:
            continue
        if not growth.recent[0]:
            break
        rows = store.put(growth.with_new_leaves(rows))
        starts = [len(w) for w in growth.weights]
        for j in models:
            for tree in growth.recent[j]:
                growth.firsts[j].append(len(growth.weights[j]))
                grown = [v for v, f in zip(tree.value, tree.feature) if f < 0]
                growth.weights[j] = np.concatenate([growth.weights[j], grown])
            trees[j] += growth.recent[j]
            growth.recent[j] = []
        for turn in range(params.rounds()):
            for j, (strip, gradient) in enumerate(growth.leaf_sums(rows, starts if turn == 0 else None)):
                if strip is not None:
                    curvature[j] = _extended(curvature[j], strip)
                growth.weights[j] = growth.weights[j] + params.learning_rate * _step(
                    growth.weights[j], gradient, CURVATURE[params.loss] * curvature[j], n[j] * params.l2)
    store.close()
    for j in models:                         # nodes in order are leaves in order
        at = 0
        for tree in trees[j]:
            for node, feature in enumerate(tree.feature):
                if feature < 0:
                    tree.value[node], at = float(growth.weights[j][at]), at + 1
    return Boosted(grow, [list(c) for c in columns], edges, trees)


def _extended(matrix: np.ndarray, strip: np.ndarray) -> np.ndarray:
    """The symmetric matrix with the rows and columns of ``strip`` (new x all) behind it."""
    old = len(matrix)
    out = np.zeros((strip.shape[1],) * 2)
    out[:old, :old], out[old:], out[:old, old:] = matrix, strip, strip[:, :old].T
    return out


def _step(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, penalty: float) -> np.ndarray:
    """Step to the least value of the penalised quadratic; without a penalty the shortest one."""
    return -np.linalg.lstsq(curvature + penalty * np.eye(len(w)), gradient + penalty * w, rcond=1e-12)[0]
