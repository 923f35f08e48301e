"""Bounded feature maps whose inner products approach a kernel, with the error measured on pairs of rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.passes import summed, vectors

Map = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Polynomial:
    """``(scale * x . y + offset) ** degree``, features by tensor sketch.

    Every factor of the product is hashed to ``dims`` places with signs of its own; the sketches are combined by circular
    convolution, which is a product of their Fourier transforms. So all products of ``degree`` inputs are in the features, whose number
    does not grow with the degree. Inner products are right on average; their mean squared error is at most ``bound``.
    """

    width: int
    degree: int
    scale: float
    offset: float
    dims: int
    seed: int = 0

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.scale * (a * b).sum(axis=1) + self.offset) ** self.degree

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        x = np.column_stack([math.sqrt(self.scale) * x, np.full(len(x), math.sqrt(self.offset))])
        total = np.ones((len(x), self.dims // 2 + 1), complex)
        for _ in range(self.degree):
            place, sign = rng.integers(self.dims, size=self.width + 1), rng.choice([-1.0, 1.0], size=self.width + 1)
            sketch = np.zeros((self.width + 1, self.dims))
            sketch[np.arange(self.width + 1), place] = sign
            total *= np.fft.rfft(x @ sketch, axis=1)
        return np.fft.irfft(total, n=self.dims, axis=1)

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Largest expected squared error of each pair: ``(2 + 3**degree) / dims`` times the squared product of both norms."""
        norms = (self.scale * (a * a).sum(axis=1) + self.offset) * (self.scale * (b * b).sum(axis=1) + self.offset)
        return (2 + 3.0 ** self.degree) / self.dims * norms ** self.degree


@dataclass(frozen=True)
class Landmarks:
    """``exp(-gamma * squared distance)``, features by the kernel with landmark rows, turned so that landmarks come out exactly."""

    points: np.ndarray
    gamma: float
    root: np.ndarray

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * ((a - b) ** 2).sum(axis=1))

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * _distances(x, self.points)) @ self.root

    @property
    def dims(self) -> int:
        return self.root.shape[1]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0)


def landmark_rows(df: DataFrame, key: str, x: str, count: int, seed: int = 0) -> np.ndarray:
    """``count`` distinct rows from the whole table, those of the smallest hash of the key; each task hands on as many at most.

    This is the documented bounded sample of the map; every row is mapped.
    """
    drawn = df.where(F.col(x).isNotNull()).select(F.xxhash64(key, F.lit(seed)).alias("h"), F.col(x).cast("array<double>").alias("x"))
    rows = drawn.orderBy("h").limit(count).collect()
    return np.unique(np.array([r["x"] for r in rows], float), axis=0)


def landmarks(points: np.ndarray, gamma: float) -> Landmarks:
    """The map of given landmarks; directions in which they do not differ are left out."""
    values, basis = np.linalg.eigh(np.exp(-gamma * _distances(points, points)))
    kept = values > 1e-10 * values.max()
    return Landmarks(points, gamma, basis[:, kept] / np.sqrt(values[kept]))


def mapped(df: DataFrame, x: str, maps: Sequence[Polynomial | Landmarks], keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and ``x``: the features of all maps side by side, as blocks for ``machines``. Rows without ``x`` go."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors(batch.column("_x"))
            wide = np.column_stack([m.features(rows) for m in maps])
            lists = pa.ListArray.from_arrays(np.arange(0, wide.size + 1, wide.shape[1], dtype=np.int32), wide.ravel())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "x"])

    held = df.where(F.col(x).isNotNull()).select(*keep, F.col(x).cast("array<double>").alias("_x"))
    return held.mapInArrow(turn, ", ".join([*fields, "x array<double>"]))


def blocks(maps: Sequence[Polynomial | Landmarks]) -> list[slice]:
    """Where the features of each map are among those of ``mapped``."""
    ends = np.cumsum([m.dims for m in maps]).tolist()
    return [slice(b - m.dims, b) for m, b in zip(maps, ends)]


def errors(df: DataFrame, x: str, maps: Sequence[Polynomial | Landmarks]) -> list[dict]:
    """Per map over pairs of rows: how many, mean squared error of the inner products, mean square of the kernel, mean stated bound.

    Each row is paired with the next of its batch, so every row is in a pair and no join is made.
    """
    held = df.where(F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("x"))

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        rows = vectors(batch.column("x"))
        a, b = rows, np.roll(rows, 1, axis=0)
        out = np.zeros((len(maps), 4))
        for i, m in enumerate(maps):
            left = m.features(a)
            exact = m.kernel(a, b)
            off = (left * np.roll(left, 1, axis=0)).sum(axis=1) - exact
            limit = m.bound(a, b).sum() if isinstance(m, Polynomial) else 0.0
            out[i] = len(a), (off ** 2).sum(), (exact ** 2).sum(), limit
        return out

    sums = summed(held, partial, len(maps), 4)
    return [{"pairs": int(n), "error": e / n if n else 0.0, "square": k / n if n else 0.0, "bound": b / n if n else 0.0}
            for n, e, k, b in sums]
