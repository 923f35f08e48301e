"""Cost-complexity pruning of fitted classification trees, with the amount of pruning chosen by cross-validation.

A fitted tree is a small table of nodes on the driver. Rows are led to leaves by a native expression, and one aggregate counts
classes per leaf, for all trees of a cross-validation together; everything else follows from those counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.models import FEATURES, assembler, complete


@dataclass(frozen=True)
class Tree:
    """Nodes in preorder: predictor and threshold of inner ones, children, -1 where there are none. At most the threshold goes left."""

    names: list[str]
    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]

    @property
    def size(self) -> int:
        return len(self.left)


@dataclass(frozen=True)
class Stage:
    """A subtree of the pruning sequence: from which cost per leaf on it is best, which nodes became leaves, and its training errors."""

    alpha: float
    pruned: frozenset[int]
    leaves: int
    errors: int


def _nodes(model, names: Sequence[str]) -> Tree:
    tree = Tree(list(names), [], [], [], [])

    def add(node) -> int:
        at = tree.size
        for column in (tree.feature, tree.threshold, tree.left, tree.right):
            column.append(-1)
        if node.getClass().getSimpleName() == "InternalNode":
            tree.feature[at], tree.threshold[at] = node.split().featureIndex(), node.split().threshold()
            tree.left[at] = add(node.leftChild())
            tree.right[at] = add(node.rightChild())
        return at

    add(model._call_java("rootNode"))
    return tree


def grow(df: DataFrame, y: str, xs: Sequence[str], min_leaf: int = 10, max_depth: int = 5, max_bins: int = 64, seed: int = 100) -> Tree:
    """A tree on the complete rows, split while impurity falls; to be pruned."""
    tree = DecisionTreeClassifier(labelCol=y, featuresCol=FEATURES, minInstancesPerNode=min_leaf, maxDepth=max_depth, maxBins=max_bins, seed=seed)
    return _nodes(tree.fit(assembler(xs).transform(complete(df, [y, *xs]))), xs)


def node_of(tree: Tree, pruned: frozenset[int] = frozenset()) -> Column:
    """The number of the leaf that a row reaches; null where a predictor is."""
    def reached(at: int) -> Column:
        if tree.left[at] < 0 or at in pruned:
            return F.lit(at)
        goes_left = F.col(tree.names[tree.feature[at]]).cast("double") <= tree.threshold[at]
        return F.when(goes_left, reached(tree.left[at])).otherwise(reached(tree.right[at]))

    known = F.lit(True)
    for x in tree.names:
        known = known & F.col(x).isNotNull()
    return F.when(known, reached(0))


def class_counts(df: DataFrame, y: str, trees: Sequence[Tree], fold: Column) -> dict[tuple[int, int], np.ndarray]:
    """Rows per node (all ancestors included) and class 0, 1, .. of every tree and fold, from one aggregate."""
    leaves = F.array(*[F.struct(F.lit(i).alias("tree"), node_of(t).alias("leaf")) for i, t in enumerate(trees)])
    cells = df.select(F.col(y).cast("int").alias("y"), fold.alias("fold"), F.inline(leaves)).where("leaf is not null and y is not null")
    rows = cells.groupBy("tree", "fold", "leaf", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    classes = 1 + max((r["y"] for r in rows), default=0)
    counts: dict[tuple[int, int], np.ndarray] = {}
    for r in rows:
        held = counts.setdefault((r["tree"], r["fold"]), np.zeros((trees[r["tree"]].size, classes), np.int64))
        held[r["leaf"], r["y"]] += r["n"]
    for (i, _), held in counts.items():
        for at in reversed(range(trees[i].size)):
            if trees[i].left[at] >= 0:
                held[at] += held[trees[i].left[at]] + held[trees[i].right[at]]
    return counts


def pruning_sequence(tree: Tree, counts: np.ndarray) -> list[Stage]:
    """Subtrees from the largest without useless splits down to the root, each by cutting the weakest links of the one before.

    The weakness of a node is what errors, as a share of all rows, rise by per leaf that goes when it becomes one.
    """
    total = max(int(counts[0].sum()), 1)
    as_leaf = counts.sum(axis=1) - counts.max(axis=1)
    pruned: frozenset[int] = frozenset()
    stages: list[Stage] = []
    alpha = 0.0
    while True:
        errors, leaves = as_leaf.copy(), np.ones(tree.size, np.int64)
        links: dict[int, tuple[int, int]] = {}
        for at in reversed(range(tree.size)):
            if tree.left[at] >= 0 and at not in pruned:
                errors[at] = errors[tree.left[at]] + errors[tree.right[at]]
                leaves[at] = leaves[tree.left[at]] + leaves[tree.right[at]]
                links[at] = int(as_leaf[at] - errors[at]), int(leaves[at] - 1)
        inside = [at for at in _kept(tree, pruned) if at in links]
        weakest = min((links[at][0] / links[at][1] for at in inside), default=math.inf)
        if weakest > alpha * total * (1 + 1e-12):
            stages.append(Stage(alpha, pruned, int(leaves[0]), int(errors[0])))
            if not inside:
                return stages
            alpha = weakest / total
        pruned = pruned | {at for at in inside if links[at][0] / links[at][1] <= weakest * (1 + 1e-12)}


def _kept(tree: Tree, pruned: frozenset[int]) -> list[int]:
    """Nodes that are still reached."""
    found, todo = [], [0]
    while todo:
        at = todo.pop()
        found.append(at)
        if tree.left[at] >= 0 and at not in pruned:
            todo += [tree.left[at], tree.right[at]]
    return found


def _leaves(tree: Tree, pruned: frozenset[int]) -> list[int]:
    return [at for at in _kept(tree, pruned) if tree.left[at] < 0 or at in pruned]


@dataclass(frozen=True)
class Pruned:
    """A tree with its pruning sequence, the cross-validated error of each stage, and the one chosen."""

    tree: Tree
    counts: np.ndarray
    stages: list[Stage]
    errors: list[float]
    spread: list[float]
    rows: int
    best: int

    def probability(self, positive: int = 1) -> Column:
        """Share of the positive class in the leaf that a row reaches in the chosen tree; null where a predictor is."""
        pruned = self.stages[self.best].pruned
        shares = {at: float(self.counts[at][positive] / max(self.counts[at].sum(), 1)) for at in _leaves(self.tree, pruned)}
        reached = node_of(self.tree, pruned)
        return F.get(F.lit([shares.get(at, 0.0) for at in range(self.tree.size)]).cast("array<double>"), reached)


def fit_pruned(df: DataFrame, y: str, xs: Sequence[str], fold: Column, folds: int = 5, one_error: bool = False, **grown) -> Pruned:
    """Grow a tree on all rows and one without each fold, prune all, and choose the pruning that left-out rows like best.

    ``fold`` numbers rows from 0, by a hash of the key for example. Ties go to the smaller tree; with ``one_error`` the smallest tree
    within one standard error of the best is taken. ``df`` is read once per tree and for the counts, so it should be a written one.
    """
    named = complete(df, [y, *xs]).withColumn("_fold", fold)
    trees = [grow(named, y, xs, **grown), *[grow(named.where(F.col("_fold") != k), y, xs, **grown) for k in range(folds)]]
    counts = class_counts(named, y, trees, F.col("_fold"))
    classes = max(c.shape[1] for c in counts.values())

    def of(i: int, wanted) -> np.ndarray:
        out = np.zeros((trees[i].size, classes), np.int64)
        for (tree, k), held in counts.items():
            if tree == i and wanted(k):
                out[:, :held.shape[1]] += held
        return out

    whole = of(0, lambda k: True)
    stages = pruning_sequence(trees[0], whole)
    wrong, asked = np.zeros(len(stages), np.int64), 0
    for i in range(1, folds + 1):
        seen, unseen = of(i, lambda k: k != i - 1), of(i, lambda k: k == i - 1)
        asked += int(unseen[0].sum())
        sequence = pruning_sequence(trees[i], seen)
        for s, stage in enumerate(stages):
            # the middle, as a ratio, of the costs for which this stage is best
            cost = math.sqrt(stage.alpha * stages[s + 1].alpha) if s + 1 < len(stages) else math.inf
            cut = max((x for x in sequence if x.alpha <= cost), key=lambda x: x.alpha)
            for at in _leaves(trees[i], cut.pruned):
                wrong[s] += int(unseen[at].sum() - unseen[at][seen[at].argmax()])
    rate = wrong / max(asked, 1)
    spread = np.sqrt(rate * (1 - rate) / max(asked, 1))
    best = max(s for s in range(len(stages)) if wrong[s] == wrong.min())
    if one_error:
        best = max(s for s in range(len(stages)) if rate[s] <= rate[best] + spread[best])
    return Pruned(trees[0], whole, stages, rate.tolist(), spread.tolist(), asked, best)
