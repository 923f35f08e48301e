"""Linear support vector machines for whole grids: all settings, folds and classes in the same passes.

A machine is a column: one class against the rest, one penalty, one block of features, one fold left out. Its objective is
``|w|^2 / 2 + c * sum(max(0, 1 - y * (w, b) . (x, 1))^2)``, which has one minimum. A pass takes the margins of all columns of a batch as
one matrix product and adds up losses and gradients, so the number of passes does not depend on the number of machines.
Columns take limited-memory quasi-Newton steps of their own, measured by the cross products of the features, and
each stops when its own gradient is small. Folds are a hash of the key, so they do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.passes import summed, vectors

MEMORY = 12
#: Passes before columns that still move are reported as not converged.
PASSES = 300
#: A gradient below this share of that at zero ends a column.
TOLERANCE = 1e-4


@dataclass(frozen=True)
class Grid:
    """Columns of a batch: class, penalty, feature block and the fold left out (-1 for none)."""

    label: np.ndarray
    c: np.ndarray
    block: np.ndarray
    fold: np.ndarray
    slices: list[slice]

    @property
    def size(self) -> int:
        return len(self.label)


@dataclass(frozen=True)
class Machines:
    """Weights of every column for the features of its block, the constant last, their objective, and whether each converged."""

    grid: Grid
    weights: list[np.ndarray]
    objective: np.ndarray
    converged: np.ndarray
    passes: int


def grid(classes: Sequence[int], penalties: Sequence[float], slices: Sequence[slice], folds: int = 0) -> Grid:
    """Every class with every penalty, block and left-out fold, and without one."""
    cells = [(k, c, b, f) for b in range(len(slices)) for c in penalties for f in range(-1, folds) for k in classes]
    label, c, block, fold = zip(*cells)
    return Grid(np.array(label), np.array(c, float), np.array(block), np.array(fold), list(slices))


def fold_of(key: Column, folds: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(max(folds, 1))).cast("int")


def _plain(df: DataFrame) -> DataFrame:
    return df.select(F.col("x").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"))


def _features(batch: pa.RecordBatch) -> np.ndarray:
    x = vectors(batch.column("x"))
    return np.column_stack([x, np.ones(len(x))])


def _block(x: np.ndarray, s: slice) -> np.ndarray:
    return np.column_stack([x[:, s], x[:, -1]])


def _sides(g: Grid, columns: np.ndarray) -> list[tuple[slice, np.ndarray]]:
    """The columns of each block, as places in ``columns``."""
    return [(s, at) for b, s in enumerate(g.slices) if len(at := np.flatnonzero(g.block[columns] == b))]


def _pass(df: DataFrame, g: Grid, weights: list[np.ndarray], todo: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Objective and gradient of the columns ``todo`` at their ``weights``."""
    label, fold, sides = g.label[todo], g.fold[todo], _sides(g, todo)
    sent = [np.stack([weights[i] for i in at]) for _, at in sides]
    width = 1 + max(w.shape[1] for w in sent)

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        x = _features(batch)
        labels, folds = (np.asarray(batch.column(c)) for c in ("label", "fold"))
        out = np.zeros((len(todo), width))
        for (s, at), w in zip(sides, sent):
            z = _block(x, s)
            sign = np.where(labels[:, None] == label[at], 1.0, -1.0)
            slack = np.maximum(0, 1 - sign * (z @ w.T)) * (folds[:, None] != fold[at])
            out[at, 0] = (slack ** 2).sum(axis=0)
            out[at, 1:1 + w.shape[1]] = -2 * (slack * sign).T @ z
        return out

    sums = summed(df, partial, len(todo), width)
    value = [0.5 * float(w @ w) + g.c[j] * row[0] for j, w, row in zip(todo, weights, sums)]
    return np.array(value), [w + g.c[j] * row[1:1 + len(w)] for j, w, row in zip(todo, weights, sums)]


def _metrics(df: DataFrame, g: Grid) -> list:
    """Per column the eigenvectors of its features' cross products and the inverse curvature bound along them, from one pass."""
    kept = sorted({(int(b), int(f)) for b, f in zip(g.block, g.fold)})
    widths = [g.slices[b].stop - g.slices[b].start + 1 for b, _ in kept]
    widest = max(widths)

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        x, folds = _features(batch), np.asarray(batch.column("fold"))
        out = np.zeros((len(kept), widest * widest))
        for i, (b, f) in enumerate(kept):
            z = _block(x, g.slices[b])[folds != f]
            out[i, :widths[i] ** 2] = (z.T @ z).ravel()
        return out

    crosses = summed(df, partial, len(kept), widest * widest)
    turned = {}
    for (b, f), n, cross in zip(kept, widths, crosses):
        values, basis = np.linalg.eigh(cross[:n * n].reshape(n, n))
        turned[b, f] = np.maximum(values, 0), basis
    return [turned[int(b), int(f)] for b, f in zip(g.block, g.fold)]


def fit(df: DataFrame, g: Grid) -> Machines:
    """Fit all columns on ``(x, label, fold)``: arrays of one length, whole numbers, and the fold of each row.

    The frame is read once per pass and should be a written one. A quasi-Newton step that does not lower its column's objective
    is replaced by one along the curvature bound, which always does. Columns that are not done after ``PASSES`` say so.
    """
    df = _plain(df)
    metric = _metrics(df, g)
    every = np.arange(g.size)
    at = [np.zeros(g.slices[b].stop - g.slices[b].start + 1) for b in g.block]
    best, slope = _pass(df, g, at, every)
    goal = [TOLERANCE * np.linalg.norm(v) for v in slope]
    moves: list[list[tuple[np.ndarray, np.ndarray, float]]] = [[] for _ in every]

    def bound_step(j: int, gradient: np.ndarray) -> np.ndarray:
        values, basis = metric[j]
        return basis @ ((basis.T @ gradient) / (1 + 2 * g.c[j] * values))

    def direction(j: int) -> np.ndarray:
        q, held = slope[j].copy(), []
        for s, y, rho in reversed(moves[j]):
            a = rho * (s @ q)
            q -= a * y
            held.append(a)
        q = bound_step(j, q)
        if moves[j]:
            _, y, rho = moves[j][-1]
            q *= 1 / (rho * (y @ bound_step(j, y)))
        for (s, y, rho), a in zip(moves[j], reversed(held)):
            q += s * (a - rho * (y @ q))
        return -q

    step = [-bound_step(j, slope[j]) for j in every]
    passes = 1
    active = np.array([np.linalg.norm(slope[j]) > goal[j] for j in every])
    while active.any() and passes < PASSES:
        todo = np.flatnonzero(active)
        value, gradient = _pass(df, g, [at[j] + step[j] for j in todo], todo)
        passes += 1
        for i, j in enumerate(todo):
            if value[i] <= best[j] + 1e-4 * (step[j] @ slope[j]):
                change = gradient[i] - slope[j]
                curve = float(change @ step[j])
                if curve > 1e-12 * float(step[j] @ step[j]):
                    moves[j] = [*moves[j][1 - MEMORY:], (step[j], change, 1 / curve)]
                at[j], best[j], slope[j] = at[j] + step[j], value[i], gradient[i]
                active[j] = np.linalg.norm(slope[j]) > goal[j]
                step[j] = direction(j)
                if step[j] @ slope[j] < 0:
                    continue
            moves[j], step[j] = [], -bound_step(j, slope[j])
    return Machines(g, at, best, ~active, passes)


def accuracy(df: DataFrame, fitted: Machines) -> list[dict]:
    """Rows and right answers of every penalty, block and fold over the rows of ``(x, label, fold)`` of that fold, in one pass.

    Of the classes of one setting the one with the largest margin answers, the smaller class of equal ones. Machines without a left-out
    fold answer all rows.
    """
    g = fitted.grid
    df = _plain(df)
    settings: dict[tuple, list[int]] = {}
    for j in range(g.size):
        settings.setdefault((int(g.block[j]), float(g.c[j]), int(g.fold[j])), []).append(j)
    cells = list(settings.items())
    sides = [(s, at, np.stack([fitted.weights[j] for j in at])) for s, at in _sides(g, np.arange(g.size))]

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        x = _features(batch)
        labels, folds = (np.asarray(batch.column(c)) for c in ("label", "fold"))
        margins = np.empty((len(x), g.size))
        for s, at, w in sides:
            margins[:, at] = _block(x, s) @ w.T
        out = np.zeros((len(cells), 2))
        for i, ((_, _, fold), columns) in enumerate(cells):
            asked = (folds == fold) | (fold < 0)
            said = g.label[columns][margins[:, columns].argmax(axis=1)]
            out[i] = asked.sum(), (asked & (said == labels)).sum()
        return out

    sums = summed(df, partial, len(cells), 2)
    return [{"block": b, "c": c, "fold": f, "n": int(n), "right": int(hits), "converged": bool(fitted.converged[columns].all())}
            for ((b, c, f), columns), (n, hits) in zip(cells, sums)]


def cross_validated(df: DataFrame, fitted: Machines) -> list[dict]:
    """Accuracy of every block and penalty over all left-out folds together, best first; ties keep the smaller penalty, then block."""
    totals: dict[tuple, list] = {}
    for cell in accuracy(df, fitted):
        if cell["fold"] >= 0:
            held = totals.setdefault((cell["block"], cell["c"]), [0, 0, True])
            held[0] += cell["n"]
            held[1] += cell["right"]
            held[2] &= cell["converged"]
    table = [{"block": b, "c": c, "n": n, "accuracy": right / n if n else float("nan"), "converged": ok}
             for (b, c), (n, right, ok) in totals.items()]
    return sorted(table, key=lambda r: (-r["accuracy"], r["c"], r["block"]))


def predicted(df: DataFrame, fitted: Machines, block: int, c: float, out: str = "prediction") -> DataFrame:
    """All rows with the answer of the machines of one block and penalty that were fitted without leaving a fold out."""
    g = fitted.grid
    columns = np.flatnonzero((g.block == block) & (g.c == c) & (g.fold == -1))
    weights, labels, s = np.stack([fitted.weights[j] for j in columns]), g.label[columns], g.slices[block]

    @F.pandas_udf("int")
    def answer(x: pd.Series) -> pd.Series:
        rows = np.array(x.tolist(), float).reshape(len(x), -1)[:, s]
        return pd.Series(labels[(rows @ weights[:, :-1].T + weights[:, -1]).argmax(axis=1)], dtype="int32")

    return df.withColumn(out, answer(F.col("x").cast("array<double>")))
