"""Penalised logistic models on raw coefficients, all fold models at once.

Minimises  sum of weighted log-losses + l1 * sum |w| + l2 / 2 * sum w^2  (the intercept is free), which is
scikit-learn's logistic regression with l1 or l2 = 1 / C, and the linear booster's elastic net.

Rows are stored once as blocks of numbers.  A round is one Spark job for every model that still moves: tasks add up loss, gradient and curvature at
the present coefficients, one aggregate sums the shards, and the driver does coordinate descent with
soft thresholds on the resulting quadratic (a direct solve without l1).  Curvature is kept in blocks
of ``BLOCK`` coordinates; all blocks step in parallel.  A step counts only if the summed objective
falls, else it is halved and judged again, so blocks that pull on one another cannot diverge.  The
driver holds k x features x ``BLOCK`` numbers whatever the number of rows.

Edge cases: a NULL input is 0 (an absent feature); constant and collinear inputs take the least
coefficients; a model whose rows hold one class, or none, ends when its objective stands still (at most
``max_iter`` rounds).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import materialize, released

BLOCK = 256
BLOCK_BYTES = 1 << 20         # inputs of a stored block of rows


@dataclass
class Linear:
    """Per model: its feature columns and (intercept, coefficients) in one array."""
    columns: list
    weights: list
    objective: list


def _places(columns: Sequence[Sequence[str]]) -> tuple[list[str], list[list[int]]]:
    physical = list(dict.fromkeys(c for own in columns for c in own))
    return physical, [[physical.index(c) for c in own] for own in columns]


def _inputs(batch: pa.RecordBatch, count: int) -> np.ndarray:
    """(1 + inputs, rows): a one for the intercept, then the inputs, NULL as 0."""
    out = np.ones((count + 1, batch.num_rows))
    for i in range(count):
        out[i + 1] = batch.column(f"x{i}").to_numpy(zero_copy_only=False)
    return np.nan_to_num(out, copy=False, nan=0.0)


def _rows(df: DataFrame, physical: list[str], *others) -> DataFrame:
    return df.select(*others, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(physical)])


def _blocks(size: int, block: int) -> list[slice]:
    return [slice(a, min(a + block, size)) for a in range(0, size, block)]


def _packed(rows: DataFrame, count: int) -> DataFrame:
    """(n, part, y, w, x): blocks of at most ``BLOCK_BYTES`` of inputs as bytes, so that a round moves a few
    long values and not every number of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, BLOCK_BYTES // (8 * (count + 1)))
        for whole in batches:
            for start in range(0, whole.num_rows, most):
                batch = whole.slice(start, most)
                part, y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "y", "w"))
                values = part.astype(np.int32), y, w, _inputs(batch, count)
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int32())} | {
                    name: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for name, v in zip(("part", "y", "w", "x"), values)})

    return rows.mapInArrow(work, "n int, part binary, y binary, w binary, x binary")


def _sums(packed: DataFrame, places: list[list[int]], weights: dict[int, np.ndarray], block: int) -> dict[int, tuple]:
    """model -> (loss, gradient, curvature blocks) at ``weights``: one job."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {j: [0.0, np.zeros(len(w)), [np.zeros((b.stop - b.start,) * 2) for b in _blocks(len(w), block)]]
                 for j, w in weights.items()}
        for batch in batches:
            for n, *values in zip(*(batch.column(c) for c in ("n", "part", "y", "w", "x"))):
                part, y, weight, x = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(values, (np.int32, float, float, float)))
                x = x.reshape(-1, n.as_py())
                for j, w in weights.items():
                    use = part != j
                    own = x[[0, *(p + 1 for p in places[j])]][:, use]
                    z, target, rw = w @ own, y[use], weight[use]
                    p = 1.0 / (1.0 + np.exp(-z))
                    total[j][0] += float((rw * (np.logaddexp(0.0, z) - target * z)).sum())
                    total[j][1] += own @ (rw * (p - target))
                    h = rw * p * (1.0 - p)
                    for into, b in zip(total[j][2], _blocks(len(w), block)):
                        into += (own[b] * h) @ own[b].T
        for j, (loss, gradient, curvature) in total.items():
            flat = np.concatenate([[loss], gradient, *[c.ravel() for c in curvature]])
            for at in range(0, len(flat), 1 << 16):
                some = flat[at:at + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"model": np.full(len(some), j, np.int32), "cell": np.arange(at, at + len(some)),
                                                  "value": some})

    found = packed.mapInArrow(work, "model int, cell long, value double").groupBy("model", "cell").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for j, w in weights.items():
        own = found[found["model"] == j]
        flat = np.zeros(1 + len(w) + sum((b.stop - b.start) ** 2 for b in _blocks(len(w), block)))
        flat[own["cell"].to_numpy()] = own["value"].to_numpy()
        at, blocks = 1 + len(w), []
        for b in _blocks(len(w), block):
            n = b.stop - b.start
            blocks.append(flat[at:at + n * n].reshape(n, n))
            at += n * n
        out[j] = flat[0], flat[1:1 + len(w)], blocks
    return out


def _penalty(w: np.ndarray, l1: float, l2: float) -> float:
    return l1 * np.abs(w[1:]).sum() + l2 / 2 * (w[1:] ** 2).sum()


def quadratic_step(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, l1: np.ndarray, l2: np.ndarray,
                   sweeps: int = 2000) -> np.ndarray:
    """Coefficients that minimise the quadratic at ``w`` with penalties l1, l2 (arrays, 0 for the intercept)."""
    if not l1.any():
        return w - np.linalg.lstsq(curvature + np.diag(l2), gradient + l2 * w, rcond=1e-12)[0]
    new, slope = w.copy(), gradient.copy()                 # slope: gradient of the smooth loss part at ``new``
    diagonal = np.diag(curvature) + l2
    for _ in range(sweeps):
        moved = 0.0
        for i in np.flatnonzero(diagonal > 1e-14):
            pull = diagonal[i] * new[i] - (slope[i] + l2[i] * new[i])
            value = np.sign(pull) * max(abs(pull) - l1[i], 0.0) / diagonal[i]
            if value != new[i]:
                slope += curvature[:, i] * (value - new[i])
                moved = max(moved, abs(value - new[i]) * np.sqrt(diagonal[i]))
                new[i] = value
        if moved < 1e-12:
            break
    return new


def fit_linear(df: DataFrame, columns: Sequence[Sequence[str]], l1: float = 0.0, l2: float = 1.0, label: str = "target",
               fold_col: str = "fold", weight_col: str | None = None, max_iter: int = 100, tolerance: float = 1e-13,
               block: int = BLOCK) -> Linear:
    """Model j of ``len(columns)`` learns from the rows whose fold is neither NULL nor j, on ``columns[j]``."""
    physical, places = _places(columns)
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = _rows(df.filter(F.col(fold_col).isNotNull()), physical, F.col(fold_col).cast("int").alias("part"),
                 F.col(label).cast("double").alias("y"), weight.alias("w"))
    with released(df.sparkSession):
        return _fit(materialize(_packed(rows, len(physical)), "linear-rows"), columns, places, l1, l2, max_iter, tolerance, block)


def _fit(packed: DataFrame, columns, places: list[list[int]], l1: float, l2: float, max_iter: int, tolerance: float, block: int) -> Linear:
    """The rounds over the stored blocks of rows."""
    at = {j: np.zeros(1 + len(p)) for j, p in enumerate(places)}          # coefficients with a known objective
    state: dict[int, tuple] = {}
    target, share = dict(at), dict.fromkeys(at, 1.0)
    live = set(at)
    for _ in range(max_iter):
        trial = {j: target[j] if j not in state else at[j] + share[j] * (target[j] - at[j]) for j in live}
        for j, (loss, gradient, curvature) in _sums(packed, places, trial, block).items():
            value = loss + _penalty(trial[j], l1, l2)
            before = state[j][0] if j in state else np.inf
            if value > before + 1e-12 * abs(before) and share[j] > 1e-6:
                share[j] /= 2
                continue
            if value < before:
                at[j] = trial[j]
            state[j] = min(value, before), gradient, curvature
            if before - value <= tolerance * max(abs(value), 1.0):
                live.discard(j)
                continue
            free = np.r_[0.0, np.ones(len(at[j]) - 1)]
            target[j], share[j] = at[j].copy(), 1.0
            for b, part in zip(_blocks(len(at[j]), block), curvature):
                target[j][b] = quadratic_step(at[j][b], gradient[b], part, l1 * free[b], l2 * free[b])
        if not live:
            break
    return Linear([list(c) for c in columns], [at[j] for j in range(len(places))], [state[j][0] for j in range(len(places))])


def predict_linear(df: DataFrame, model: Linear, fold_col: str = "fold", id_col: str = "id", split_col: str = "split") -> DataFrame:
    """(id, split, fold, pred): rows with a fold by their own fold's model, test rows by every model; one scan."""
    physical, places = _places(model.columns)
    rows = _rows(df.filter(F.col(fold_col).isNotNull() | (F.col(split_col) == "test")), physical,
                 F.col(id_col).alias("id"), F.coalesce(F.col(fold_col).cast("int"), F.lit(-1)).alias("part"))
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, x = batch.column("part").to_numpy(), _inputs(batch, len(physical))
            for j, own in enumerate(places):
                use = np.flatnonzero((part == j) | (part < 0))
                z = model.weights[j] @ x[[0, *(p + 1 for p in own)]][:, use]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(use)), pa.array(part[use] >= 0), pa.array(np.full(len(use), j, np.int32)),
                     pa.array(1.0 / (1.0 + np.exp(-z)))], ["id", "labelled", "fold", "pred"])

    out = rows.mapInArrow(work, f"id {kind}, labelled boolean, fold int, pred double")
    return out.select(F.col("id").alias(id_col), F.when(F.col("labelled"), "train").otherwise("test").alias(split_col), "fold", "pred")
