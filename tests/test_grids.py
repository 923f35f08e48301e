"""Batched machines, kernel maps and pruned trees next to plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import kernels, machines, passes, trees


def plain_machine(x: np.ndarray, sign: np.ndarray, c: float) -> np.ndarray:
    """One machine by Newton steps on its active rows, with halving."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])

    def value(v):
        return 0.5 * v @ v + c * (np.maximum(0, 1 - sign * (z @ v)) ** 2).sum()

    for _ in range(200):
        slack = np.maximum(0, 1 - sign * (z @ w))
        gradient = w - 2 * c * z.T @ (slack * sign)
        on = z[slack > 0]
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * on.T @ on, gradient)
        t = 1.0
        while value(w - t * step) > value(w) and t > 1e-10:
            t /= 2
        w = w - t * step
        if np.linalg.norm(gradient) < 1e-9:
            break
    return w


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(3, size=240)
    x = rng.normal(size=(240, 4)) + 1.5 * np.eye(4)[label]
    fold = rng.integers(2, size=240)
    frame = pd.DataFrame({"x": [list(map(float, r)) for r in x], "label": label, "fold": fold, "id": range(240)})
    return spark.createDataFrame(frame).repartition(3).cache(), x, label, fold


def test_batch_agrees_with_single_fits(clouds, monkeypatch):
    monkeypatch.setattr(machines, "TOLERANCE", 1e-7)
    df, x, label, fold = clouds
    grid = machines.grid(range(3), [0.01, 1.0, 100.0], [slice(0, 4), slice(1, 3)], folds=2)
    fitted = machines.fit(df, grid)
    assert fitted.converged.all() and grid.size == 3 * 3 * 2 * 3
    for j in range(grid.size):
        kept = fold != grid.fold[j]
        single = plain_machine(x[kept][:, grid.slices[grid.block[j]]], np.where(label[kept] == grid.label[j], 1.0, -1.0), grid.c[j])
        assert fitted.weights[j] == pytest.approx(single, abs=1e-4 * (1 + np.abs(single).max()))


def test_cross_validation_counts_left_out_rows(clouds):
    df, x, label, fold = clouds
    grid = machines.grid(range(3), [1.0], [slice(0, 4)], folds=2)
    fitted = machines.fit(df, grid)
    right = 0
    for f in range(2):
        columns = [j for j in range(grid.size) if grid.fold[j] == f]
        z = np.column_stack([x, np.ones(len(x))])[fold == f]
        right += (np.column_stack([z @ fitted.weights[j] for j in columns]).argmax(axis=1) == label[fold == f]).sum()
    (row,) = machines.cross_validated(df, fitted)
    assert (row["n"], row["accuracy"]) == (240, pytest.approx(right / 240))
    said = machines.predicted(df, fitted, 0, 1.0)
    assert said.where("prediction = label").count() == [r for r in machines.accuracy(df, fitted) if r["fold"] == -1][0]["right"] > 150


def test_machines_that_do_not_get_there_say_so(clouds, monkeypatch):
    monkeypatch.setattr(machines, "PASSES", 2)
    df, *_ = clouds
    assert not machines.fit(df, machines.grid([0], [10.0], [slice(0, 4)])).converged.any()


def test_sums_over_rows(spark):
    df = spark.range(1000).repartition(7)
    found = passes.summed(df, lambda b: np.array([[b.num_rows, np.asarray(b.column("id")).sum()], [0.0, 0.0]]), 2, 2)
    assert found.tolist() == [[1000.0, 499500.0], [0.0, 0.0]]
    assert passes.summed(df.where("id < 0"), lambda b: np.ones((2, 2)), 2, 2).tolist() == [[0.0, 0.0], [0.0, 0.0]]


def test_sketch_is_right_on_average():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 30, 6))
    for degree in (1, 2, 3):
        maps = [kernels.Polynomial(6, degree, 0.4, 1.0, 64, seed=s) for s in range(300)]
        off = np.array([(m.features(a) * m.features(b)).sum(axis=1) - m.kernel(a, b) for m in maps])
        limit = maps[0].bound(a, b)
        assert ((off ** 2).mean(axis=0) <= limit).all()
        assert (np.abs(off.mean(axis=0)) <= 4 * np.sqrt(limit / 300)).all()


def test_landmarks_come_out_exactly(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "x": [list(map(float, r)) for r in x]})).repartition(4)
    points = kernels.landmark_rows(df, "id", "x", 40)
    assert points.shape == (40, 3) and np.array_equal(points, kernels.landmark_rows(df.repartition(2), "id", "x", 40))
    m = kernels.landmarks(points, 0.3)
    inner = m.features(points) @ m.features(points).T
    assert inner == pytest.approx(np.exp(-0.3 * ((points[:, None] - points) ** 2).sum(axis=2)), abs=1e-6)
    (error,) = kernels.errors(df, "x", [m])
    assert error["pairs"] == 300 and math.sqrt(error["error"]) < 0.1
    wide = kernels.mapped(df, "x", [m, kernels.Polynomial(3, 2, 1.0, 1.0, 16)], ["id"])
    assert kernels.blocks([m, kernels.Polynomial(3, 2, 1.0, 1.0, 16)]) == [slice(0, m.dims), slice(m.dims, m.dims + 16)]
    assert {len(r["x"]) for r in wide.collect()} == {m.dims + 16} and wide.count() == 300
    doubled = kernels.landmark_rows(df.unionAll(df).withColumn("id", F.col("id") % 3), "id", "x", 40)
    assert len(doubled) <= 40 and np.isfinite(kernels.landmarks(doubled, 0.3).root).all()


def random_tree(depth: int) -> tuple[trees.Tree, np.ndarray]:
    tree, counts = trees.Tree(["a"], [], [], [], []), []

    def add(level: int) -> int:
        at = tree.size
        for column in (tree.feature, tree.threshold, tree.left, tree.right):
            column.append(-1)
        counts.append(np.array([random.randint(0, 9), random.randint(0, 9)]))
        if level < depth and random.random() < 0.8:
            tree.feature[at] = 0
            tree.left[at] = add(level + 1)
            tree.right[at] = add(level + 1)
            counts[at] = counts[tree.left[at]] + counts[tree.right[at]]
        return at

    add(0)
    return tree, np.array(counts)


def cheapest(tree: trees.Tree, counts: np.ndarray, alpha: float, at: int = 0) -> tuple[float, int, int]:
    """Cost, leaves and errors of the smallest subtree of least cost, by trying both choices at every node."""
    wrong = int(counts[at].sum() - counts[at].max())
    leaf = (wrong / counts[0].sum() + alpha, 1, wrong)
    if tree.left[at] < 0:
        return leaf
    a, b = cheapest(tree, counts, alpha, tree.left[at]), cheapest(tree, counts, alpha, tree.right[at])
    split = (a[0] + b[0], a[1] + b[1], a[2] + b[2])
    return leaf if leaf[0] <= split[0] + 1e-12 else split


def test_pruning_gives_the_cheapest_subtrees():
    random.seed(7)
    for _ in range(150):
        tree, counts = random_tree(4)
        if not counts[0].sum():
            continue
        stages = trees.pruning_sequence(tree, counts)
        assert stages[-1].leaves == 1 and [s.alpha for s in stages] == sorted({s.alpha for s in stages})
        ends = [s.alpha for s in stages[1:]] + [stages[-1].alpha + 1]
        for stage, end in zip(stages, ends):
            for cost in (stage.alpha, (stage.alpha + end) / 2):
                assert cheapest(tree, counts, cost)[1:] == (stage.leaves, stage.errors)


def test_pruned_tree_of_planted_boxes(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(size=(1500, 3))
    clean = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(int)
    y = np.where(rng.random(1500) < 0.1, 1 - clean, clean)
    frame = pd.DataFrame({"id": range(1500), "a": x[:, 0], "b": x[:, 1], "noise": x[:, 2], "y": y})
    df = spark.createDataFrame(frame).repartition(3).cache()
    found = trees.fit_pruned(df, "y", ["a", "b", "noise"], machines.fold_of(F.col("id"), 5), max_depth=7, min_leaf=5)
    best = found.stages[found.best]
    assert 3 <= best.leaves <= 6 < found.stages[0].leaves and found.rows == 1500
    said = df.withColumn("p", found.probability())
    assert said.where("(p >= 0.5) = (y = 1)").count() == 1500 - best.errors
    none = df.withColumn("a", F.when(F.col("id") % 10 > 0, F.col("a")))
    assert none.withColumn("p", found.probability()).where("p is null").count() == 150
    simple = trees.fit_pruned(df, "y", ["a", "b", "noise"], machines.fold_of(F.col("id"), 5), one_error=True, max_depth=7, min_leaf=5)
    assert simple.stages[simple.best].leaves <= best.leaves
