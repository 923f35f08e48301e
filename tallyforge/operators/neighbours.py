"""Exact nearest neighbours in many numeric and categorical dimensions, by blocks of a k-d partition.

Points are cut into blocks of bounded size, round by round: every block that is too large is cut along its widest feature into about as
many parts as it would fill blocks. A category of several levels is 1 wide and comes before numbers no wider, and its levels are dealt out;
numbers are cut at percentiles, and only a value that many points share is a part of its own. Each part keeps its box: the interval of every
feature and the set of every category. A point's neighbours in its own block, or the box of a larger part around it where that block has too few,
bound how far away better ones can be, and boxes farther than that are not visited; pairs of boxes are followed down the partition from its root,
so distant parts are dropped whole. A task holds one block and a bounded number of the points that ask for it, and hands on the best
``k`` of each point, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.session import materialise

BLOCK_ROWS = 2048
#: Percentiles that a block is cut at, at most.
CUTS = 7
#: Points that ask for a block in one go.
ASKING = 4096
#: Levels of a category that a box lists, and parts that one is cut into, at most; with more levels a box counts as holding any.
LEVELS = 64
#: Groups of a task that looks for neighbours.
GROUPS = 32
CELLS = 4_000_000
NEAR = "vid long, d2 double, n_vid long, n_mult long, n_num array<double>, n_cat array<string>"
ROOT = "0"


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), width)


def _nearest(rows: pd.DataFrame, others: pd.DataFrame, k: int, n_num: int, n_cat: int) -> pd.DataFrame:
    """The ``k`` rows of ``others`` nearest to each of ``rows``, a row never being its own neighbour.

    Distances are worked out for a slice of ``rows`` at a time, so memory does not grow with the square of a block. Ties
    go to the smaller ``vid``, whatever order the rows arrive in.
    """
    others = others.sort_values("vid", ignore_index=True)
    b, b_vid = _matrix(others["num"], n_num), others["vid"].to_numpy()
    cats = [pd.factorize(np.array([c[j] for side in (rows, others) for c in side["cat"]], dtype=object))[0] for j in range(n_cat)]
    found = []
    for start in range(0, len(rows), max(1, CELLS // max(1, len(others)))):
        part = rows.iloc[start:start + max(1, CELLS // max(1, len(others)))]
        a = _matrix(part["num"], n_num)
        d2 = np.zeros((len(part), len(others)))
        for j in range(n_num):
            d2 += np.subtract.outer(a[:, j], b[:, j]) ** 2
        for codes in cats:
            d2 += np.not_equal.outer(codes[start:start + len(part)], codes[len(rows):])
        vid = part["vid"].to_numpy()
        d2[vid[:, None] == b_vid[None, :]] = np.inf
        take = min(k, len(others))
        best = np.argsort(d2, axis=1, kind="stable")[:, :take]
        at = np.repeat(np.arange(len(part)), take)
        chosen = others.iloc[best.ravel()]
        found.append(pd.DataFrame({
            "vid": vid[at], "d2": d2[at, best.ravel()], "n_vid": chosen["vid"].to_numpy(), "n_mult": chosen["mult"].to_numpy(),
            "n_num": chosen["num"].to_numpy(), "n_cat": chosen["cat"].to_numpy()}))
    result = pd.concat(found)
    return result[np.isfinite(result["d2"])]


def _boxes(rows: DataFrame, n_num: int, n_cat: int) -> DataFrame:
    """``node, n, low, high, levels`` of every part; a null set of levels stands for any."""
    def every(n: int, make: Callable[[int], Column], kind: str) -> Column:
        return F.array(*[make(i) for i in range(n)]) if n else F.array().cast(kind)

    def listed(i: int) -> Column:
        found = F.collect_set(F.coalesce(F.get("cat", F.lit(i)), F.lit("\0")))
        return F.when(F.size(found) <= LEVELS, F.array_sort(found))

    return rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), every(n_num, lambda i: F.min(F.get("num", F.lit(i))), "array<double>").alias("low"),
        every(n_num, lambda i: F.max(F.get("num", F.lit(i))), "array<double>").alias("high"),
        every(n_cat, listed, "array<array<string>>").alias("levels"))


def partition(points: DataFrame, n_num: int, n_cat: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The points with the block they are in as ``node``, and the boxes of all parts with their ``parent`` and ``leaf``, both written.

    Points alike in everything are cut by a hash of ``vid``. Parts are named by their path from the root. Every round writes the points once; there
    are as many as the logarithm of the number of blocks.
    """
    rows = materialise(points.withColumn("node", F.lit(ROOT)), "blocks")
    boxes = []
    turn = 0
    while True:
        box = materialise(_boxes(rows, n_num, n_cat).withColumn("leaf", F.col("n") <= block_rows), "boxes")
        boxes.append(box)
        large = box.where(~F.col("leaf"))
        if not large.limit(1).count():
            break
        spans = F.zip_with("high", "low", lambda h, l: h - l)
        widths = F.concat(F.transform("levels", lambda x: F.when(x.isNotNull() & (F.size(x) == 1), 0.0).otherwise(1.0)), spans)
        widest = F.when(F.coalesce(F.array_max(widths), F.lit(0.0)) > 0, F.array_position(widths, F.array_max(widths)).cast("int") - 1)
        # a null axis: all points are alike; categories are counted first
        parts = F.ceil(F.col("n") / block_rows).cast("int")
        axes = large.select("node", widest.alias("axis"), parts.alias("parts"), F.get("high", widest - n_cat).alias("end"),
                              F.get("levels", widest).alias("listed"))
        held = rows.join(axes, "node").withColumn("value", F.get("num", F.col("axis") - n_cat))
        many = F.percentile_approx("value", [i / (CUTS + 1) for i in range(1, CUTS + 1)], 1000)
        taken = F.filter("many", lambda c, i: F.floor((i + 1) * F.least("parts", F.lit(CUTS + 1)) / (CUTS + 1)) > F.floor(
            i * F.least("parts", F.lit(CUTS + 1)) / (CUTS + 1)))
        cuts = held.where(F.col("axis") >= n_cat).groupBy("node", "parts", "end").agg(many.alias("many")).select(
            "node", F.array_distinct(taken).alias("cuts"), F.filter(F.array_distinct("many"), lambda c: (c == F.col("end")) | (
                F.size(F.filter("many", lambda x: x == c)) > 1)).alias("shared"))
        several = F.least("parts", F.lit(LEVELS))
        level = F.coalesce(F.get("cat", "axis"), F.lit("\0"))
        hashed = F.when(F.col("axis").isNull(), F.xxhash64("vid", F.lit(turn))).otherwise(F.xxhash64(level, F.lit(turn)))
        dealt = F.coalesce(F.floor((F.array_position("listed", level) - 1) * several / F.size("listed")), F.pmod(hashed, several))
        cut = F.array_contains("cuts", F.col("value")) & F.array_contains("shared", F.col("value"))
        place = F.when(F.col("axis").isNull() | (F.col("axis") < n_cat), dealt).otherwise(
            2 * F.size(F.filter("cuts", lambda c: c < F.col("value"))) + cut.cast("int"))
        moved = held.join(cuts, "node", "left").withColumn("node", F.concat_ws(".", "node", place.cast("string")))
        settled = rows.join(box.where("leaf").select("node"), "node", "left_semi")
        rows = materialise(moved.select(*rows.columns).unionByName(settled.select(*rows.columns)), "blocks")
        turn += 1
    # parts that stay are met again in later rounds
    whole = reduce(DataFrame.unionByName, boxes).dropDuplicates(["node"])
    return rows, materialise(whole.withColumn("parent", F.regexp_replace("node", r"\.?[^.]*$", "")), "boxes")


def _box_distance(a: str, b: str) -> Column:
    """Least squared distance of points in two boxes."""
    def gap(i: str) -> Column:
        return F.zip_with(F.col(f"{a}.low"), F.col(f"{b}.high"), lambda l, h: l - h) if i == "above" else F.zip_with(
            F.col(f"{b}.low"), F.col(f"{a}.high"), lambda l, h: l - h)

    gaps = F.zip_with(gap("above"), gap("below"), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.zip_with(F.col(f"{a}.levels"), F.col(f"{b}.levels"), lambda x, y: F.when(
        x.isNotNull() & y.isNotNull() & ~F.arrays_overlap(x, y), 1.0).otherwise(0.0))
    total = F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g * g)
    return F.aggregate(apart, total, lambda t, g: t + g)


def _far(boxes: str) -> Column:
    """Greatest squared distance of a point, ``num``, to points in a box around it."""
    box = F.col(boxes)
    ends = F.zip_with(F.zip_with("num", box["low"], lambda x, l: x - l), F.zip_with("num", box["high"], lambda x, h: h - x), lambda a, b: F.greatest(a, b))
    several = F.size(F.filter(box["levels"], lambda x: x.isNull() | (F.size(x) > 1)))
    return F.aggregate(ends, several.cast("double"), lambda t, g: t + g * g)


def _above(node: str) -> Column:
    """Paths of the parts around a part, from the root down to itself."""
    steps = F.split(node, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "."))


def pairs_within(boxes: DataFrame, reach: DataFrame) -> DataFrame:
    """``block, target``: other leaves that some point of a leaf may have neighbours in; ``reach`` has ``node, reach2`` of the leaves."""
    inside = reach.select("reach2", F.explode(_above("node")).alias("node"))
    wide = inside.groupBy("node").agg(F.max("reach2").alias("reach2"))
    box = materialise(boxes.join(wide, "node").select("node", "parent", "leaf", F.struct("low", "high", "levels", "reach2").alias("box")), "reaches")
    # a leaf leads to itself, any other part to its own parts
    steps = box.where("parent <> ''").select(F.col("parent").alias("from"), F.col("node"), "leaf", "box").unionByName(
        box.where("leaf").select(F.col("node").alias("from"), "node", "leaf", "box"))
    frontier = box.where(F.col("node") == ROOT).select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("leaf").alias("done"))
    while frontier.where("not done").limit(1).count():
        left = steps.select(F.col("from").alias("a"), F.col("node").alias("a2"), F.col("leaf").alias("a_leaf"), F.col("box").alias("p"))
        right = steps.select(F.col("from").alias("b"), F.col("node").alias("b2"), F.col("leaf").alias("b_leaf"), F.col("box").alias("q"))
        met = frontier.join(left, "a").join(right, "b").where(_box_distance("p", "q") <= F.col("p.reach2"))
        frontier = materialise(met.select(F.col("a2").alias("a"), F.col("b2").alias("b"), (F.col("a_leaf") & F.col("b_leaf")).alias("done")),
                               "block-pairs")
    return frontier.where("a <> b").select(F.col("a").alias("block"), F.col("b").alias("target"))


def _dealt(rows: DataFrame, groups: int, *keys: str) -> GroupedData:
    """Rows by group, a bounded number of groups to a task however few bytes they are."""
    return rows.repartition(max(1, -(-groups // GROUPS)), *keys).groupBy(*keys)


def nearest_rows(points: DataFrame, n_num: int, n_cat: int, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest other points of each point, as rows of ``NEAR`` plus their order ``place``.

    ``points`` has ``vid`` (unique), ``mult``, ``num`` and ``cat``. A category that differs counts 1. Among
    equally distant points the smaller ``vid`` comes first, so blocks make no difference.
    """
    rows, boxes = partition(points.select("vid", "mult", "num", "cat"), n_num, n_cat, block_rows)
    leaves = boxes.where("leaf").count()
    first = materialise(_dealt(rows, leaves, "node").applyInPandas(lambda own: _nearest(own, own, k, n_num, n_cat), NEAR), "near")
    order = W.partitionBy("vid").orderBy("d2", "n_vid")
    if leaves == 1:  # there is no other block
        return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    # a little wider than the distance, which is worked out in another order of additions
    wider = lambda d2: d2 * (1 + 1e-9) + 1e-12
    reach = first.groupBy("vid").agg(F.when(F.count(F.lit(1)) >= k, wider(F.max("d2"))).alias("reach2"))
    known = materialise(rows.join(reach, "vid", "left"), "reach")
    # in a small block: no farther than the far side of the smallest part around it that holds k others; rows may repeat a vid
    around = boxes.select(F.col("node").alias("part"), F.col("n").alias("held"), F.struct("low", "high", "levels").alias("box"))
    alone = known.where("reach2 is null").select("vid", "num", "node")
    alone = alone.join(alone.groupBy("vid").agg(F.count(F.lit(1)).alias("copies")), "vid")
    short = alone.select("*", F.explode(_above("node")).alias("part")).join(around, "part").where(F.col("held") >= F.col("copies") + k).groupBy(
        "vid", "node", "num").agg(wider(F.min(_far("box"))).alias("bound")).groupBy("vid").agg(F.max("bound").alias("bound"))
    asking = materialise(known.join(short, "vid", "left").withColumn("reach2", F.coalesce("reach2", "bound", F.lit(float("inf")))).drop("bound"),
                         "asking")
    pairs = pairs_within(boxes, asking.groupBy("node").agg(F.max("reach2").alias("reach2")))
    point = F.struct(F.col("num").alias("low"), F.col("num").alias("high"), F.transform(
        "cat", lambda c: F.array(F.coalesce(c, F.lit("\0")))).alias("levels"))
    asks = asking.withColumnRenamed("node", "block").join(pairs, "block").join(
        boxes.select(F.col("node").alias("target"), F.struct("low", "high", "levels").alias("q")), "target").withColumn("p", point)
    asks = materialise(asks.where(_box_distance("p", "q") <= F.col("reach2")).select("target", "vid", "mult", "num", "cat", "reach2"), "asks")
    asked = materialise(asks.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("bigint").alias("portions")), "asked")
    dealt = asks.join(asked, "target").select("target", F.pmod(F.xxhash64("vid"), "portions").alias("portion"), "vid", "mult", "num", "cat", "reach2")
    targets = rows.withColumnRenamed("node", "target").join(asked, "target").select(
        "target", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("portions") - 1)).alias("portion"), "vid", "mult", "num", "cat",
        F.lit(None).cast("double").alias("reach2"))

    def other(both: pd.DataFrame) -> pd.DataFrame:
        own = both["reach2"].notna()
        found = _nearest(both[own], both[~own], k, n_num, n_cat)
        reach2 = both[own].drop_duplicates("vid").set_index("vid")["reach2"]
        return found[~(found["d2"].to_numpy() > found["vid"].map(reach2).to_numpy())]

    groups = asked.agg(F.sum("portions")).first()[0] or 0
    second = _dealt(dealt.unionByName(targets), groups, "target", "portion").applyInPandas(other, NEAR)
    return first.unionByName(second).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
