"""Sums of matrices over all rows, for fits whose every pass is one Spark job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(df: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], rows: int, width: int) -> np.ndarray:
    """The sum of ``partial(batch)``, a ``rows`` by ``width`` matrix, over all Arrow batches of a frame.

    A task adds up its own batches; what tasks have is added up row by row on the executors, in the order of the tasks, so a run
    on the same partitions repeats to the last bit. One matrix reaches the driver.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for batch in batches:
            if batch.num_rows:
                total += partial(batch)
        held = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([
            pa.array(held, pa.int32()), pa.array(np.full(len(held), TaskContext.get().partitionId()), pa.int32()),
            pa.array([total[i].tobytes() for i in held], pa.binary())], ["k", "task", "v"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        parts = [np.frombuffer(v, np.float64) for v in table.column("v").to_pylist()]
        return pa.table({"k": table.column("k")[:1], "v": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

    found = df.mapInArrow(add, "k int, task int, v binary").groupBy("k").applyInArrow(join, "k int, v binary")
    out = np.zeros((rows, width))
    for row in found.collect():
        out[row["k"]] = np.frombuffer(row["v"], np.float64)
    return out


def matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Columns of numbers as one matrix, a row each."""
    return np.column_stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float) for c in columns])


def vectors(column: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, float).reshape(len(column), -1)


def spread(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations of all columns, in one aggregate; a constant column counts as one wide."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    means = np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))])
    widths = np.array([row[f"s{i}"] or 1.0 for i in range(len(columns))])
    return means, widths
