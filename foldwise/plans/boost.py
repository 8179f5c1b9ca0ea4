"""Second-order boosted trees over binned rows, all fold models at once.

Rows are binned once (quantile edges from one ``percentile_approx`` aggregate over all rows, bin 0
for NULL) and stored with one margin per fold model.  A step of growth is one Spark job for all
models: tasks route their rows to the leaves, add up (count, gradient, hessian) per leaf, feature and
bin, and one aggregate sums the shards.  What reaches the driver is that table of sums: leaves x
features x bins cells, however many rows there are; at most ``CELLS`` of them a job.

* Gradients are rounded to integers of a scale that follows from the row count, so sums are exact
  and the trees do not depend on partitions or retries.
* Of two sibling leaves only the one with fewer rows is scanned; the other is parent minus sibling.
* ``num_leaves`` grows best-first, one split a step and model; ``max_depth`` alone grows by level.
* Splits use L1 (soft threshold of the gradient sum), L2, minimum gain, minimum hessian and
  minimum rows; NULLs go to whichever side gains more.  Ties go to the first feature, then bin.
* Columns are drawn per tree and per level, rows per tree (or every ``subsample_freq`` trees), by hash.
* The objective ``pairwise`` takes gradients over all positive-negative pairs (plans/pairwise.py): one
  more pass a tree sums the classes per score bucket of every model.  Predictions stay sigmoids of margins.
* The margins are written anew after every tree, so no step repeats the work of earlier trees.  Every
  ``refresh`` trees all stages since the last time are scored with one grouped Gini pass, from the held-out
  margin each row kept (``held``), and the models stop whose held-out Gini has not risen for ``early_stop`` stages.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ordered import running_sums
from foldwise.plans import pairwise
from foldwise.session import default_buckets, delete_path, released, scratch_path

CELLS = 4_000_000            # (leaf, feature, bin) cells a job may return
# parameter names of the two native libraries -> fields of BoostParams
NAMES = {"eta": "learning_rate", "lambda": "reg_lambda", "alpha": "reg_alpha", "max_leaves": "num_leaves",
         "bagging_fraction": "subsample", "bagging_freq": "subsample_freq", "feature_fraction": "colsample_bytree",
         "min_split_gain": "gamma", "min_split_loss": "gamma", "num_round": "n_estimators"}
IGNORED = {"n_jobs", "nthread", "silent", "booster"}         # neither changes a model
OBJECTIVES = {"binary:logistic": "logistic", "binary": "logistic", "logistic": "logistic",
              "rank:pairwise": "pairwise", "pairwise": "pairwise"}


@dataclass(frozen=True)
class BoostParams:
    learning_rate: float = 0.1
    n_estimators: int = 100
    max_depth: int | None = None                 # None: 6 by level, unlimited with num_leaves
    num_leaves: int = 0
    max_bin: int = 255
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    min_child_samples: int = 1
    subsample: float = 1.0
    subsample_freq: int = 1
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    scale_pos_weight: float = 1.0
    objective: str = "logistic"
    seed: int = 1024

    @classmethod
    def of(cls, param: dict) -> BoostParams:
        """From a spec's parameters; an unknown name or objective raises."""
        named = {NAMES.get(k, k): v for k, v in param.items() if k not in IGNORED}
        unknown = sorted(named.keys() - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown parameters of a boosted model: {unknown}")
        if "objective" in named:
            if named["objective"] not in OBJECTIVES:
                raise ValueError(f"unknown objective {named['objective']!r}")
            named["objective"] = OBJECTIVES[named["objective"]]
        return cls(**named)

    def depth(self) -> float:
        return self.max_depth if self.max_depth and self.max_depth > 0 else math.inf if self.num_leaves else 6


@dataclass
class Tree:
    """Node arrays; ``feature`` -1 marks a leaf.  Bins up to ``cut`` go left, bin 0 (NULL) as ``null_left`` says."""
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    null_left: list = field(default_factory=lambda: [False])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    depth: list = field(default_factory=lambda: [0])
    gain: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, null_left: bool, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.null_left[node], self.gain[node] = feature, cut, null_left, gain
        for side in ("left", "right"):
            getattr(self, side)[node] = len(self.feature)
            for name, start in (("feature", -1), ("cut", 0), ("null_left", False), ("left", 0), ("right", 0),
                                ("value", 0.0), ("depth", self.depth[node] + 1), ("gain", 0.0)):
                getattr(self, name).append(start)
        return self.left[node], self.right[node]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """Node of every row: all rows go down together."""
        feature, cut, null_left = np.array(self.feature), np.array(self.cut), np.array(self.null_left)
        left, right = np.array(self.left), np.array(self.right)
        node, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            live = live[feature[node[live]] >= 0]
            if not len(live):
                return node
            at = node[live]
            b = bins[live, feature[at]]
            node[live] = np.where(np.where(b == 0, null_left[at], b <= cut[at]), left[at], right[at])

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Boosted:
    """Trees of every fold model, the bin edges they refer to, and each model's best stage."""
    params: BoostParams
    columns: list            # per model: its feature columns
    edges: dict              # column -> ascending bin edges
    trees: list              # per model: its trees
    best: list | None = None           # per model: best stage (from 1), with early stopping

    def stages(self, model: int) -> int:
        """Stages a prediction uses: with early stopping ten beyond the best one, as the reference does."""
        return len(self.trees[model]) if self.best is None else min(len(self.trees[model]), self.best[model] + 10)


# ---- bins ---------------------------------------------------------------------------------------

def quantile_edges(df: DataFrame, columns: Sequence[str], max_bin: int, accuracy: int = 10_000) -> dict[str, list[float]]:
    """Distinct quantiles of every column from one aggregate (a sketch merged over the partitions).  A
    column with few values, each holding a bin's share of rows, gets one bin per value."""
    points = [i / max_bin for i in range(1, max_bin + 1)]
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), points, accuracy).alias(f"q{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(columns)}


def _bins(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """(rows, columns) uint16: 0 for NULL, else 1 + number of edges below the value (values beyond the last join it)."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint16)
    for i, (x, e) in enumerate(zip(columns, edges)):
        known = ~np.isnan(x)
        out[known, i] = 1 + np.minimum(np.searchsorted(e, x[known], side="left"), max(len(e) - 1, 0))
    return out


class _Store:
    """The binned rows with their margins, written anew after every tree; older copies are deleted."""

    def __init__(self, spark):
        self.spark, self.base, self.turn = spark, scratch_path(spark, "boost"), 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.turn}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if self.turn:
            delete_path(self.spark, f"{self.base}/{self.turn - 1}")
        self.turn += 1
        return out

    def close(self) -> None:
        delete_path(self.spark, self.base)


ROW = "id {id}, part int, y double, w double, draw long, bins binary, held double, margins binary"


def _binned(df: DataFrame, columns: list[str], edges: dict, k: int, id_col: str, label: str, fold_col: str,
            weight_col: str | None) -> DataFrame:
    """Rows as ``ROW``; ``part`` is the fold of labelled rows, -1 for the others."""
    cuts = [np.array(edges[c], float) for c in columns]
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(fold_col).cast("int"), F.lit(-1)).alias("part"),
        F.col(label).cast("double").alias("y"),
        (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("w"),
        F.xxhash64(id_col).alias("draw"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bins = _bins([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(cuts))], cuts)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "part", "y", "w", "draw")],
                 _cells(bins), pa.array(np.zeros(n)), _cells(np.zeros((n, k)))],
                ["id", "part", "y", "w", "draw", "bins", "held", "margins"])

    return rows.mapInArrow(work, ROW.format(id=df.schema[id_col].dataType.simpleString()))


def _matrix(column, kind) -> np.ndarray:
    """Binary cells of equal length as the rows of a matrix, on the column's own buffer."""
    n = len(column)
    if not n:
        return np.zeros((0, 0), kind)
    _, ends, data = column.buffers()
    first, last = (int(np.frombuffer(ends, np.int32, 1, 4 * (column.offset + i))[0]) for i in (0, n))
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, (last - first) // size, first).reshape(n, -1) if last > first else np.zeros((n, 0), kind)


def _cells(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary cells."""
    matrix = np.ascontiguousarray(matrix)
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1] * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(matrix)])


# ---- gradients and sums -------------------------------------------------------------------------

def _chosen(draw: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Whether the row is in the sample: a hash of the row and the seed, equal on every engine run."""
    if share >= 1:
        return np.ones(len(draw), bool)
    h = draw.view(np.uint64) ^ np.uint64(int(hashlib.md5(str(seed).encode()).hexdigest()[:16], 16))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h ^ (h >> np.uint64(33))) < np.uint64(min(int(share * 2.0 ** 64), 2 ** 64 - 1))


def logistic_gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return (p - y) * w, np.maximum(p * (1.0 - p), 1e-16) * w


class Growth:
    """State of the fit that the tasks need; small: parameters, trees the margins lack, places of columns."""

    def __init__(self, params: BoostParams, places: list[list[int]], bins: int, scale: float):
        self.params, self.places, self.bins, self.scale = params, places, bins, scale
        self.recent: list[list[Tree]] = [[] for _ in places]      # trees since the margins were written
        self.growing: list[Tree | None] = [None] * len(places)
        self.turn = 0                                              # number of the tree that grows
        self.span = [[0.0, 0.0] for _ in places]                   # least and greatest margin the trees can give
        self.pairs: list[np.ndarray | None] = [None] * len(places)     # pairwise: gradients by score bucket

    def margins(self, bins: np.ndarray, stored: np.ndarray) -> np.ndarray:
        out = stored.copy()
        for j, trees in enumerate(self.recent):
            for tree in trees:
                out[:, j] += tree.values(bins[:, self.places[j]])
        return out

    def margins_of(self, batch: pa.RecordBatch, bins: np.ndarray) -> np.ndarray:
        return self.margins(bins, _matrix(batch.column("margins"), float))

    def drawn(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows of the current tree's sample, of any fold."""
        p = self.params
        return (batch.column("part").to_numpy(zero_copy_only=False) >= 0) & _chosen(
            batch.column("draw").to_numpy(), p.seed + self.turn // max(1, p.subsample_freq), p.subsample)

    def gradients(self, j: int, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = w * np.where(y == 1, self.params.scale_pos_weight, 1.0)
        if self.params.objective != "pairwise":
            return logistic_gradients(y, weight, margin)
        at = pairwise.bucket_of(margin, *self.span[j])
        g_pos, h_pos, g_neg, h_neg = self.pairs[j]
        return np.where(y == 1, g_pos[at], g_neg[at]) * weight, np.where(y == 1, h_pos[at], h_neg[at]) * weight

    def meet_pairs(self, rows: DataFrame, models: list[int]) -> None:
        """Pairwise gradients of every score bucket, from exact class sums of one pass over the rows."""
        size, unit = pairwise.BUCKETS, self.scale / 2.0 ** 8

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, len(self.places) * size), np.int64)
            low, high = np.full(total.shape[1], np.inf), np.full(total.shape[1], -np.inf)
            for batch in batches:
                part, y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "y", "w"))
                margins = self.margins(_matrix(batch.column("bins"), np.uint16), _matrix(batch.column("margins"), float))
                drawn = self.drawn(batch)
                for j in models:
                    use = np.flatnonzero(drawn & (part != j))
                    margin, positive = margins[use, j], y[use] == 1
                    cell = pairwise.bucket_of(margin, *self.span[j])
                    weight = np.rint(w[use] * np.where(positive, self.params.scale_pos_weight, 1.0) * unit)
                    own = slice(j * size, (j + 1) * size)
                    for side, mine in ((0, positive), (1, ~positive)):
                        total[side, own] += np.bincount(cell[mine], weight[mine], size).astype(np.int64)
                    np.minimum.at(low[own], cell, margin)
                    np.maximum.at(high[own], cell, margin)
            at = np.flatnonzero(high >= low)
            yield pa.RecordBatch.from_pydict({"cell": at, "pos": total[0][at], "neg": total[1][at], "low": low[at], "high": high[at]})

        found = rows.mapInArrow(work, "cell long, pos long, neg long, low double, high double").groupBy("cell").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        found["bucket"] = found["cell"] % size
        for j in models:
            own = found[found["cell"] // size == j].copy()
            own[["pos", "neg"]] = own[["pos", "neg"]] / unit
            self.pairs[j] = pairwise.tables(own)

    def sums(self, rows: DataFrame, scan: list[tuple[int, int]]) -> np.ndarray:
        """(scanned leaf, feature, bin, [rows, gradient, hessian]) as exact integers; ``scan`` lists (model, leaf)."""
        wide = max(len(p) for p in self.places)
        at_once = max(1, CELLS // (wide * self.bins))
        out = np.zeros((len(scan), wide, self.bins, 3), np.int64)
        for first in range(0, len(scan), at_once):
            part = scan[first:first + at_once]
            found = self._shards(rows, part, wide).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g"),
                                                                       F.sum("h").alias("h")).toPandas()
            flat = out[first:first + len(part)].reshape(-1, 3)
            flat[found["cell"].to_numpy()] = found[["n", "g", "h"]].to_numpy()
        return out

    def _shards(self, rows: DataFrame, scan: list[tuple[int, int]], wide: int) -> DataFrame:
        slots: dict[int, dict[int, int]] = {}
        for slot, (model, leaf) in enumerate(scan):
            slots.setdefault(model, {})[leaf] = slot
        count = len(scan)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, count, wide, self.bins), np.int64)
            for batch in batches:
                part, y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "y", "w"))
                bins = _matrix(batch.column("bins"), np.uint16)
                margins = self.margins_of(batch, bins)
                drawn = self.drawn(batch)
                for j, leaves in slots.items():
                    use = np.flatnonzero(drawn & (part != j))
                    own = bins[np.ix_(use, self.places[j])]
                    slot_of = np.full(len(self.growing[j].feature), -1)
                    slot_of[list(leaves)] = list(leaves.values())
                    slot = slot_of[self.growing[j].leaf_of(own)]
                    use, own, slot = use[slot >= 0], own[slot >= 0], slot[slot >= 0]
                    g, h = self.gradients(j, y[use], w[use], margins[use, j])
                    g, h = np.rint(g * self.scale), np.rint(h * self.scale)
                    for f in range(own.shape[1]):
                        cell = slot * self.bins + own[:, f]
                        for channel, weights in enumerate((None, g, h)):
                            found = np.bincount(cell, weights, count * self.bins).astype(np.int64)
                            total[channel, :, f] += found.reshape(count, self.bins)
            total = total.reshape(3, -1)
            some = np.flatnonzero(total[0])
            for first in range(0, len(some), 1 << 16):
                at = some[first:first + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"cell": at, "n": total[0][at], "g": total[1][at], "h": total[2][at]})

        return rows.mapInArrow(work, "cell long, n long, g long, h long")


# ---- splits -------------------------------------------------------------------------------------

def leaf_value(g, h, params: BoostParams):
    """Newton step under L1 and L2, times the learning rate."""
    return -np.sign(g) * np.maximum(np.abs(g) - params.reg_alpha, 0.0) / np.maximum(h + params.reg_lambda, 1e-300) * params.learning_rate


def leaf_score(g, h, params: BoostParams):
    t = np.maximum(np.abs(g) - params.reg_alpha, 0.0)
    return t * t / (h + params.reg_lambda)


def best_split(sums: np.ndarray, params: BoostParams, allowed: np.ndarray, scale: float):
    """(gain, feature, cut, null_left) of one leaf's sums (feature, bin, 3), or None.

    All cuts of all features and both ways for NULL are scored at once."""
    whole = sums[0].sum(axis=0)
    below = sums[:, 1:].cumsum(axis=1)                               # (feature, cut, 3) without NULLs
    left = np.stack([below, below + sums[:, :1]], axis=2)            # NULLs right, NULLs left
    right = whole - left
    n_l, n_r = left[..., 0], right[..., 0]
    g_l, g_r, h_l, h_r = left[..., 1] / scale, right[..., 1] / scale, left[..., 2] / scale, right[..., 2] / scale
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = leaf_score(g_l, h_l, params) + leaf_score(g_r, h_r, params) \
            - leaf_score(whole[1] / scale, whole[2] / scale, params) - params.gamma
    least = max(1, params.min_child_samples)
    ok = (n_l >= least) & (n_r >= least) & (h_l >= params.min_child_weight) & (h_r >= params.min_child_weight)
    gain = np.where(ok & allowed[:, None, None] & (gain > 1e-12), gain, -np.inf)
    at = int(gain.argmax())
    if not np.isfinite(gain.flat[at]):
        return None
    feature, cut, side = np.unravel_index(at, gain.shape)
    return float(gain.flat[at]), int(feature), int(cut) + 1, bool(side)


def _columns_drawn(count: int, share: float, seed: str, among: np.ndarray) -> np.ndarray:
    """Mask of the columns drawn among ``among``: those with the least hashes, one at least."""
    if share >= 1:
        return among
    names = np.flatnonzero(among)
    order = sorted(names, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    out = np.zeros(count, bool)
    out[order[:max(1, round(share * len(names)))]] = True
    return out


def _grow(growth: Growth, rows: DataFrame, models: list[int]) -> None:
    """One tree for each of ``models``, grown together: a job per step whatever their number."""
    p, scale = growth.params, growth.scale
    count = {j: len(growth.places[j]) for j in models}
    by_tree = {j: _columns_drawn(count[j], p.colsample_bytree, f"{p.seed}:{j}:{growth.turn}", np.ones(count[j], bool))
               for j in models}
    for j in models:
        growth.growing[j] = Tree()

    def split_of(j: int, leaf: int, sums: np.ndarray):
        depth = growth.growing[j].depth[leaf]
        if depth >= p.depth():
            return None
        columns = _columns_drawn(count[j], p.colsample_bylevel, f"{p.seed}:{j}:{growth.turn}:{depth}", by_tree[j])
        return best_split(sums[:count[j]], p, columns, scale)

    if p.objective == "pairwise":
        growth.meet_pairs(rows, models)
    held: dict[tuple[int, int], tuple] = {}                # open leaves: (sums, best split)

    def open_leaf(j: int, leaf: int, sums: np.ndarray) -> None:
        whole = sums[0].sum(axis=0)
        growth.growing[j].value[leaf] = float(leaf_value(whole[1] / scale, whole[2] / scale, p))
        found = split_of(j, leaf, sums)
        if found:
            held[j, leaf] = sums, found

    roots = [(j, 0) for j in models]
    for (j, leaf), sums in zip(roots, growth.sums(rows, roots)):
        if sums[0, :, 0].sum():
            open_leaf(j, leaf, sums)
    leaves = dict.fromkeys(models, 1)
    while held:
        if p.num_leaves:                                   # best first: one leaf of each model
            chosen = {}
            for (j, leaf), (_, found) in held.items():
                if leaves[j] < p.num_leaves and (j not in chosen or found[0] > held[j, chosen[j]][1][0]):
                    chosen[j] = leaf
            chosen = list(chosen.items())
        else:
            chosen = list(held)
        if not chosen:
            break
        scan, other = [], []
        for j, leaf in chosen:
            sums, (gain, feature, cut, null_left) = held.pop((j, leaf))
            left, right = growth.growing[j].split(leaf, feature, cut, null_left, gain)
            leaves[j] += 1
            rows_left = sums[feature, 1:cut + 1, 0].sum() + (sums[feature, 0, 0] if null_left else 0)
            small = left if 2 * rows_left <= sums[0, :, 0].sum() else right
            scan.append((j, small))
            other.append((left + right - small, sums))
        for (j, small), (large, sums), part in zip(scan, other, growth.sums(rows, scan)):
            open_leaf(j, small, part)
            open_leaf(j, large, sums - part)
    for j in models:
        growth.recent[j].append(growth.growing[j])
        leaves_of = [v for v, f in zip(growth.growing[j].value, growth.growing[j].feature) if f < 0]
        growth.span[j] = [growth.span[j][0] + float(min(leaves_of)), growth.span[j][1] + float(max(leaves_of))]


# ---- fit and predict ----------------------------------------------------------------------------

def fit_boosted(df: DataFrame, columns: Sequence[Sequence[str]], params: BoostParams, label: str = "target",
                fold_col: str = "fold", id_col: str = "id", weight_col: str | None = None, early_stop: int = 0,
                refresh: int = 10) -> Boosted:
    """Model j of ``len(columns)`` learns from the rows whose fold is neither NULL nor j, on ``columns[j]``.

    ``early_stop``: stages without a better held-out Gini after which a model stops (0: never)."""
    spark, k = df.sparkSession, len(columns)
    physical = list(dict.fromkeys(c for own in columns for c in own))
    labelled = df.filter(F.col(fold_col).isNotNull())
    edges = quantile_edges(labelled, physical, params.max_bin)
    store = _Store(spark)
    binned = _binned(labelled, physical, edges, k, id_col, label, fold_col, weight_col)
    rows = store.put(binned.repartition(default_buckets(spark), "draw"))
    size = rows.agg(F.count(F.lit(1)), F.max("w")).first()
    most = max(1.0, (size[0] or 1) * (size[1] or 1.0) * max(1.0, params.scale_pos_weight))
    # a pair gradient can exceed 1 by the ratio of the classes: fewer bits leave it the room
    scale = 2.0 ** min(30 if params.objective == "pairwise" else 36, 61 - math.ceil(math.log2(most)))
    places = [[physical.index(c) for c in own] for own in columns]
    growth = Growth(params, places, 2 + max((len(e) for e in edges.values()), default=0), scale)
    trees: list[list[Tree]] = [[] for _ in range(k)]
    scores: list[list[float]] = [[] for _ in range(k)]
    live = list(range(k))
    unjudged: list[list[Tree]] = [[] for _ in range(k)]
    while live and growth.turn < params.n_estimators:
        _grow(growth, rows, live)
        growth.turn += 1
        for j in live:
            trees[j].append(growth.growing[j])
            unjudged[j].append(growth.growing[j])
        due = bool(early_stop) and (growth.turn % refresh == 0 or growth.turn == params.n_estimators)
        if due:
            for (j, stage), value in _stage_ginis(rows, growth, live, unjudged).items():
                scores[j].append(value)
            live = [j for j in live if len(scores[j]) - _best_stage(scores[j]) < early_stop]
            unjudged = [[] for _ in range(k)]
        if live and growth.turn < params.n_estimators:
            rows = store.put(_with_margins(rows, growth, due))
        growth.recent = [[] for _ in range(k)]
    store.close()
    best = [_best_stage(s) for s in scores] if early_stop else None
    return Boosted(params, [list(c) for c in columns], edges, trees, best)


def _best_stage(scores: list[float]) -> int:
    """First stage (from 1) with the highest Gini; 0 without stages."""
    return 1 + max(range(len(scores)), key=lambda i: (scores[i], -i)) if scores else 0


def _with_margins(rows: DataFrame, growth: Growth, judged: bool) -> DataFrame:
    """Rows with present margins; those just ``judged`` keep the one of the model that does not learn from them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = growth.margins(_matrix(batch.column("bins"), np.uint16), _matrix(batch.column("margins"), float))
            held = batch.column("held")
            if judged:
                part = batch.column("part").to_numpy()
                own = (part >= 0) & (part < margins.shape[1])
                held = pa.array(np.where(own, margins[np.arange(len(part)), np.where(own, part, 0)], 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], held, _cells(margins)], batch.schema.names)

    return rows.mapInArrow(work, rows.schema)


def _stage_ginis(rows: DataFrame, growth: Growth, models: list[int], trees: list[list[Tree]]) -> dict[tuple[int, int], float]:
    """Held-out Gini of every model after each of its last ``trees``, by one grouped pass."""
    recent = len(trees[models[0]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, y = batch.column("part").to_numpy(), batch.column("y").to_numpy(zero_copy_only=False)
            bins, held = _matrix(batch.column("bins"), np.uint16), batch.column("held").to_numpy()
            for j in models:
                own = part == j
                if own.any():
                    yield _stage_rows(j, y[own], held[own], bins[np.ix_(own, growth.places[j])], trees[j], range(1, recent + 1))

    long = rows.mapInArrow(work, "model int, y double, scores array<double>")
    with released(rows.sparkSession):
        table = stage_ginis(long, ["model"], "scores").collect()
    found = {(r["model"], r["stage"]): -math.inf if r["gini"] is None else r["gini"] for r in table}
    return {(j, s): found.get((j, s), -math.inf) for j in models for s in range(1, recent + 1)}


def _stage_rows(model: int, y, start, bins, trees: list[Tree], stages) -> pa.RecordBatch:
    """Margins after the given stages as one array per row."""
    wanted, out, now = set(stages), [], start.copy()
    for stage, tree in enumerate(trees, 1):
        now = now + tree.values(bins)
        if stage in wanted:
            out.append(now)
    scores = np.stack(out, axis=1) if out else np.zeros((len(y), 0))
    return pa.RecordBatch.from_pydict({"model": pa.array(np.full(len(y), model, np.int32)), "y": pa.array(y),
                                       "scores": pa.array(list(scores), pa.list_(pa.float64()))})


def stage_ginis(rows: DataFrame, by: Sequence[str], scores: str, label: str = "y") -> DataFrame:
    """(by, stage, gini): every element of the array of stage scores judged in one grouped ordered pass."""
    long = rows.select(*by, label, F.posexplode(scores).alias("stage", "p"))
    long = long.groupBy(*by, "stage", "p").agg(F.sum(label).alias("_p"), F.count(label).alias("_n"))
    # rows of one score come as two weighted rows, so a stage costs its distinct scores
    return gini_weighted(long.withColumn("stage", F.col("stage") + 1), [*by, "stage"])


def gini_weighted(scores: DataFrame, by: list[str]) -> DataFrame:
    """Gini of (p, positives ``_p``, rows ``_n``) per group."""
    g = scores.select(*by, "p", F.col("_p").cast("double").alias("_pos"), (F.col("_n") - F.col("_p")).cast("double").alias("_neg"))
    r = running_sums(g, list(by), ["p"], ["_neg"])
    above = F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2.0))
    return r.groupBy(*by).agg((F.try_divide(F.lit(2.0) * above, F.sum("_pos") * F.sum("_neg")) - F.lit(1.0)).alias("gini"))


def _scorer(model: Boosted):
    """bins of ``physical`` columns, per model the places of its own."""
    physical = list(dict.fromkeys(c for own in model.columns for c in own))
    return physical, [[physical.index(c) for c in own] for own in model.columns]


def predict_boosted(df: DataFrame, model: Boosted, label: str = "target", fold_col: str = "fold", id_col: str = "id",
                    split_col: str = "split") -> DataFrame:
    """(id, split, fold, pred): rows with a fold by their own fold's model, test rows by every model."""
    physical, places = _scorer(model)
    k = len(places)
    rows = df.filter(F.col(fold_col).isNotNull() | (F.col(split_col) == "test")).withColumn("_y", F.col(label).cast("double"))
    kept = _binned(rows, physical, model.edges, 0, id_col, "_y", fold_col, None)
    names = {"id": df.schema[id_col].dataType.simpleString()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, bins = batch.column("part").to_numpy(), _matrix(batch.column("bins"), np.uint16)
            for j in range(k):
                use = np.flatnonzero((part == j) | (part < 0))
                own = bins[np.ix_(use, places[j])] if len(use) else np.zeros((0, len(places[j])), np.uint16)
                margin = np.zeros(len(use))
                for tree in model.trees[j][:model.stages(j)]:
                    margin += tree.values(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(use)), pa.array(part[use] >= 0),
                     pa.array(np.full(len(use), j, np.int32)), pa.array(1.0 / (1.0 + np.exp(-margin)))],
                    ["id", "labelled", "fold", "pred"])

    out = kept.mapInArrow(work, "id {id}, labelled boolean, fold int, pred double".format(**names))
    return out.select(F.col("id").alias(id_col), F.when(F.col("labelled"), "train").otherwise("test").alias(split_col), "fold", "pred")


def learning_curve_gini(df: DataFrame, model: Boosted, label: str = "target", fold_col: str = "fold", id_col: str = "id",
                        every: int = 1) -> DataFrame:
    """(fold, stage, train_gini, valid_gini) of all fold models after every ``every`` stages."""
    physical, places = _scorer(model)
    rows = _binned(df.filter(F.col(fold_col).isNotNull()), physical, model.edges, 0, id_col, label, fold_col, None)
    stages = [list(range(every, len(t) + 1, every)) for t in model.trees]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, y = batch.column("part").to_numpy(), batch.column("y").to_numpy(zero_copy_only=False)
            bins = _matrix(batch.column("bins"), np.uint16)
            for j in range(len(places)):
                found = _stage_rows(j, y, np.zeros(len(y)), bins[:, places[j]], model.trees[j], stages[j])
                yield found.append_column("held_out", pa.array(part == j))

    long = rows.mapInArrow(work, "model int, y double, scores array<double>, held_out boolean")
    table = stage_ginis(long, ["model", "held_out"], "scores")
    return (table.groupBy("model", "stage").agg(F.max(F.when(~F.col("held_out"), F.col("gini"))).alias("train_gini"),
                                                F.max(F.when(F.col("held_out"), F.col("gini"))).alias("valid_gini"))
            .select(F.col("model").alias("fold"), (F.col("stage") * every).cast("int").alias("stage"), "train_gini", "valid_gini"))


def with_seed(params: BoostParams, seed: int) -> BoostParams:
    return replace(params, seed=seed)
