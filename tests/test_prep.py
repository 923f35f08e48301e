"""Preparation, binning, weights of evidence, sampling and oversampling."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import bands
from tallyforge.operators import prep, sampling, woe
from tallyforge.operators.neighbours import nearest_rows, pairs_within, partition
from tallyforge.operators.smote import smote


def test_clamp_keeps_nulls(spark, rows):
    df = spark.createDataFrame([(1.0,), (5.0,), (9.0,), (None,)], "x double")
    assert rows(prep.clamp(df, {"x": (2.0, 8.0)})) == [(None,), (2.0,), (5.0,), (8.0,)]
    assert rows(prep.clamp(df, {"x": (None, 4.0)})) == [(None,), (1.0,), (4.0,), (4.0,)]


def test_clamp_at_percentiles(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    low, high = prep.clamp_at_percentiles(df, "x", 0.02, 0.98).agg(F.min("x"), F.max("x")).first()
    assert (low, high) == (2.0, 98.0)


def test_impute(spark, rows):
    df = spark.createDataFrame([("b", 1.0), ("b", None), ("a", 3.0), ("a", 8.0), (None, None)], "c string, x double")
    full = prep.impute(df, {"c": "mode", "x": "median"})
    assert rows(full) == [("a", 3.0), ("a", 3.0), ("a", 8.0), ("b", 1.0), ("b", 3.0)]
    assert prep.impute(df, {"x": "mean"}).agg(F.sum("x")).first()[0] == 20.0
    assert prep.impute(df, {"c": "missing"}).where("c = 'missing'").count() == 1


def test_levels_and_dummies(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "i int, c string")
    assert prep.dummies(df, ["c"]).columns == ["i", "c_y", "c_z"]
    assert rows(prep.dummies(df, ["c"])) == [(1, 0, 0), (2, 1, 0), (3, 0, 1), (4, None, None)]
    assert prep.dummies(df, ["c"], drop_first=False).columns == ["i", "c_x", "c_y", "c_z"]
    two = spark.createDataFrame([("No",), ("Yes",)], "c string")
    assert rows(prep.binary_encode(two, "c")) == [(0,), (1,)]


def test_zscore_and_rescale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "x double, same double")
    z = prep.zscore(df, ["x", "same"])
    values = sorted(r[0] for r in z.collect())
    x = np.array([1, 2, 6.0])
    assert values == pytest.approx(sorted((x - x.mean()) / x.std(ddof=1)))
    assert {r[1] for r in z.collect()} == {None}
    scaled = prep.rescale(spark.createDataFrame([(0,), (255,)], "p int"), ["p"])
    assert [r[0] for r in scaled.collect()] == [0.0, 1.0]


def test_boxplot(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 1.0)], "g string, x double")
    got = {r["g"]: r for r in prep.boxplot_stats(df, "x", ["g"]).collect()}
    assert (got["a"]["q1"], got["a"]["median"], got["a"]["q3"], got["a"]["n_outlier"]) == (2.0, 3.0, 4.0, 1)
    assert (got["a"]["low_fence"], got["a"]["high_fence"], got["b"]["n_outlier"]) == (-1.0, 7.0, 0)


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 50 + list(range(1, 51))], "x double")
    counts = {r["bin"]: r["n"] for r in prep.quantile_bins(df, "x", 10).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert sum(counts.values()) == 100 and counts[1] >= 50
    one = prep.quantile_bins(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 4)
    assert {r["bin"] for r in one.collect()} == {1}


def test_woe_table(spark):
    data = ([("a", 1)] * 10 + [("a", 0)] * 30 + [("b", 1)] * 20 + [("b", 0)] * 20 + [("only_good", 0)] * 5
            + [(None, 1)] * 2 + [(None, 0)] * 3)
    df = spark.createDataFrame(data, "c string, bad int")
    bins = woe.bin_columns(df, [], ["c"])
    table = {r["bin"]: r for r in woe.woe_table(df, bins, F.col("bad")).collect()}
    assert set(table) == {"a", "b", "only_good", "NA"}
    pe, po = 10 / 32, 30 / 58
    assert table["a"]["woe"] == pytest.approx(math.log(pe / po), abs=1e-6)
    assert table["a"]["iv"] == pytest.approx((pe - po) * math.log(pe / po), abs=1e-6)
    assert table["only_good"]["pct_events"] == pytest.approx(0.5 / 32, abs=1e-6)
    full = woe.woe_table(df, bins, F.col("bad"))
    ranked = woe.iv_ranking(full).first()
    assert ranked["iv"] == pytest.approx(sum(r["iv"] for r in table.values()), abs=1e-5)
    replaced = woe.woe_transform(df, full, bins)
    assert replaced.where("c IS NULL").first()["c_woe"] == table["NA"]["woe"]


def test_woe_of_interval_bins(spark):
    df = spark.createDataFrame([(float(i), int(i > 60)) for i in range(100)] + [(None, 1)], "x double, bad int")
    bins = woe.bin_columns(df, ["x"], bins=4)
    table = woe.woe_table(df, bins, F.col("bad"))
    assert {r["bin"] for r in table.collect()} == {"[0,24.75]", "(24.75,49.5]", "(49.5,74.25]", "(74.25,99]", "NA"}
    later = spark.createDataFrame([(-50.0, 0), (500.0, 1)], "x double, bad int")
    assert [r["b"] for r in later.select(bins["x"].alias("b")).collect()] == ["[0,24.75]", "(74.25,99]"]


def test_shares_of_hashes(spark):
    df = spark.range(100)
    assert sampling.share_of_hashes(0.5) == "80000000"
    assert [sampling.sample_fraction(df, "id", f).count() for f in (0.0, 1.0)] == [0, 100]


def test_split_is_stable(spark):
    df = spark.range(2000)
    one = {r["id"]: r["part"] for r in sampling.split(df, "id", 0.7, 1).collect()}
    two = {r["id"]: r["part"] for r in sampling.split(df.repartition(7), "id", 0.7, 1).collect()}
    assert one == two and 0.65 < sum(p == "train" for p in one.values()) / 2000 < 0.75
    assert one != {r["id"]: r["part"] for r in sampling.split(df, "id", 0.7, 2).collect()}


@pytest.mark.parametrize("rows_per_slice", [100_000, 50])
def test_stratified_split(spark, rows_per_slice):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") < 900, "common").when(F.col("id") < 990, "rare"))
    got = sampling.stratified_split(df, "id", "y", 0.7, 5, rows_per_slice=rows_per_slice).groupBy("y", "part").count().collect()
    assert {(r["y"], r["part"]): r["count"] for r in got} == {
        ("common", "train"): 630, ("common", "test"): 270, ("rare", "train"): 63, ("rare", "test"): 27,
        (None, "train"): 7, (None, "test"): 3}
    one = sampling.stratified_split(df, "id", "y", 0.7, 5)
    two = sampling.stratified_split(df, "id", "y", 0.7, 5, rows_per_slice=20)
    assert sorted(map(tuple, one.select("id", "part").collect())) == sorted(map(tuple, two.select("id", "part").collect()))
    many = sampling.stratified_split(spark.range(1200), "id", "id", 1.0)
    assert many.where("part = 'train'").count() == 1200  # a stratum for every row


@pytest.mark.parametrize("n", [0, 1, 37, 500, 900])
def test_sample_n(spark, n):
    df = spark.range(500)
    got = {r["id"] for r in sampling.sample_n(df, "id", n, 3).collect()}
    ranked = [r["id"] for r in df.orderBy(sampling.key_hash("id", 3), "id").collect()]
    assert got == set(ranked[:n])
    assert got == {r["id"] for r in sampling.sample_n(df, "id", n, 3, rows_per_slice=30).collect()}


@pytest.mark.parametrize("block_rows", [1000, 25, 7])
def test_nearest_rows_are_exact(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    points = [(int(i), int(rng.integers(1, 4)), [float(v) for v in p], ["u" if c else "w"])
              for i, (p, c) in enumerate(zip(rng.random((120, 3)).round(3), rng.random(120) < 0.5))]
    df = spark.createDataFrame(points, "vid long, mult long, num array<double>, cat array<string>")
    got: dict[int, list[float]] = {}
    for r in nearest_rows(df, 3, 1, 4, block_rows).collect():
        got.setdefault(r["vid"], []).append(r["d2"])
    for vid, _, p, c in points:
        all_d2 = sorted(sum((a - b) ** 2 for a, b in zip(p, q)) + (c != e) for w, _, q, e in points if w != vid)
        assert sorted(got[vid]) == pytest.approx(all_d2[:4])


def test_blocks_in_many_dimensions_are_pruned(spark):
    """Clusters in five dimensions, one constant feature, a column that is nearly always the same and rows alike in all numbers."""
    rng = np.random.default_rng(4)
    centres = rng.uniform(0, 10, size=(12, 5))
    num = centres[rng.integers(12, size=600)] + rng.normal(scale=0.05, size=(600, 5))
    num[:, 3] = 1.0
    num[rng.random(600) < 0.8, 4] = 0.0
    num[:60] = num[0]
    cat = [[f"c{i}" if i < 60 else "x", None if i % 9 == 0 else "y"] for i in range(600)]
    points = [(i, 1, [float(v) for v in p], c) for i, (p, c) in enumerate(zip(num, cat))]
    df = spark.createDataFrame(points, "vid long, mult long, num array<double>, cat array<string>").repartition(3)
    rows, boxes = partition(df, 5, 2, 25)
    assert rows.count() == 600 and rows.groupBy("node").count().agg(F.max("count")).first()[0] <= 25
    leaves = boxes.where("leaf").count()
    pairs = pairs_within(boxes, rows.select("node").distinct().withColumn("reach2", F.lit(0.01)))
    assert 0 < pairs.count() < 0.3 * leaves * (leaves - 1)
    got: dict[int, list] = {}
    for r in nearest_rows(df, 5, 2, 4, 25).collect():
        got.setdefault(r["vid"], []).append((r["place"], r["n_vid"], r["d2"]))
    for vid, _, p, c in points:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q)) + sum(x != y for x, y in zip(c, e)), w) for w, _, q, e in points if w != vid)[:4]
        assert [d for _, _, d in sorted(got[vid])] == pytest.approx([d for d, _ in near], abs=1e-12)


def test_smote(spark):
    rng = np.random.default_rng(1)
    data = [(i, 1, float(rng.random()), float(rng.random()), "s") for i in range(40)]
    data += [(100 + i, 1, 0.5, 0.5, "hot") for i in range(30)]        # many copies of one row
    data += [(1000 + i, 0, 5.0 + i, 9.0, "t") for i in range(300)]
    df = spark.createDataFrame(data, "id long, y int, a double, b double, c string")
    made = smote(df, "y", "id", ["a", "b"], ["c"], over=300, under=200, k=5, seed=2, block_rows=16)
    counts = {r["y"]: r["count"] for r in made.groupBy("y").count().collect()}
    assert counts == {1: 70 + 210, 0: 420}                            # 300 exist, so some are taken twice
    rare = made.where("y = 1")
    low_a, high_a, low_b, high_b = rare.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    assert 0 <= low_a and high_a <= 1 and 0 <= low_b and high_b <= 1  # between existing rows
    assert {r["c"] for r in rare.select("c").distinct().collect()} <= {"s", "hot"}
    hot = rare.where("a = 0.5 AND b = 0.5").count()
    assert hot >= 30 + 90                                             # copies stay copies
    again = smote(df.repartition(5), "y", "id", ["a", "b"], ["c"], over=300, under=200, k=5, seed=2, block_rows=16)
    key = lambda d: sorted((r["y"], round(r["a"], 9), round(r["b"], 9), r["c"]) for r in d.collect())
    assert key(made) == key(again)


def test_smote_shares(spark):
    """1000 per cent over and 200 per cent under give 11 : 20."""
    data = [(i, int(i < 10), float(i % 7), float(i)) for i in range(400)]
    df = spark.createDataFrame(data, "id long, y int, a double, b double")
    counts = {r["y"]: r["count"] for r in smote(df, "y", "id", ["a", "b"], over=1000, under=200).groupBy("y").count().collect()}
    assert counts == {1: 110, 0: 200}


def test_cut_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (5.1,), (9.0,), (9.1,), (None,)], "x double")
    got = [r[0] for r in df.select(bands.cut("x", [0, 5, 9])).collect()]
    assert got == [None, "(0,5]", "(0,5]", "(5,9]", "(5,9]", None, None]
    lowest = [r[0] for r in df.select(bands.cut("x", [0, 5, 9], include_lowest=True)).collect()]
    assert lowest[0] == "[0,5]"


@pytest.mark.parametrize("low,high", [(0, 60), (-0.5, 61.3), (4.5, 60), (1e-3, 2e-3), (7, 7)])
def test_round_breaks_cover(low, high):
    breaks = bands.round_breaks(low, high)
    assert breaks[0] <= low and breaks[-1] >= high and breaks == sorted(set(breaks)) and 2 <= len(breaks) <= 12


def test_blocks_follow_categories_and_no_cut_is_a_block(spark):
    """Rows of many pairs of categories: blocks hold few of them, none is a single value on a cut, and hardly any other block is asked."""
    rng = np.random.default_rng(8)
    points = [(i, 1, [float(v) for v in rng.random(2)], [f"a{i % 5}", f"b{i // 5 % 8}"]) for i in range(1600)]
    df = spark.createDataFrame(points, "vid long, mult long, num array<double>, cat array<string>")
    rows, boxes = partition(df, 2, 2, 25)
    sizes = [r["count"] for r in rows.groupBy("node").count().collect()]
    assert sum(sizes) == 1600 and 5 < min(sizes) and max(sizes) <= 25
    pairs = pairs_within(boxes, rows.select("node").distinct().withColumn("reach2", F.lit(0.5))).count()
    assert pairs <= 4 * len(sizes)
    few = [p for p in points if p[0] < 200] + [(5000 + i, 1, [0.5, 0.5], ["rare", None]) for i in range(2)]
    got: dict[int, list] = {}
    for r in nearest_rows(spark.createDataFrame(few, df.schema), 2, 2, 4, 25).collect():
        got.setdefault(r["vid"], []).append((r["place"], r["d2"], r["n_vid"]))
    for vid, _, p, c in few:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q)) + sum(x != y for x, y in zip(c, e)), w) for w, _, q, e in few if w != vid)[:4]
        assert [d for _, d, _ in sorted(got[vid])] == pytest.approx([d for d, _ in near], abs=1e-12)


def test_neighbours_of_repeated_keys(spark):
    """Rows that share a key are no neighbours of each other, and the key has the best of them all; blocks make no difference."""
    rng = np.random.default_rng(3)
    points = [(i % 150, 1, [float(v) for v in rng.random(2)], [f"a{rng.integers(6)}", None if i % 5 else "q"]) for i in range(210)]
    points += [(7, 1, [0.1, 0.1], ["z", "q"])] * 3 + [(900, 1, [0.9, 0.1], ["y", "q"])] * 8 + points[:40]
    df = spark.createDataFrame(points, "vid long, mult long, num array<double>, cat array<string>")
    got: dict[int, list] = {}
    for r in nearest_rows(df, 2, 2, 5, 16).collect():
        got.setdefault(r["vid"], []).append((r["place"], r["d2"]))
    for vid in {p[0] for p in points}:
        every = [sorted(sum((a - b) ** 2 for a, b in zip(x[2], y[2])) + sum(c != d for c, d in zip(x[3], y[3])) for y in points if y[0] != vid)[:5]
                 for x in points if x[0] == vid]
        assert [d for _, d in sorted(got[vid])] == pytest.approx(sorted(sum(every, []))[:5], abs=1e-12)
