"""Every ranking operator with one range and with many, against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.operators import ranking

LARGE = {"rows_per_range": 40}
WAYS = pytest.mark.parametrize("options", [{}, LARGE], ids=["one range", "ranges"])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 1500
    # a third of the rows share one score, and one group holds most rows
    score = np.where(rng.random(n) < 0.33, 7.25, rng.normal(10, 4, n).round(2))
    group = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    data = [(int(i), float(s), str(g), int(w)) for i, (s, g, w) in enumerate(zip(score, group, rng.integers(0, 5, n)))]
    data += [(n, None, "a", 1), (n + 1, 3.0, None, 2), (n + 2, 4.0, None, 1)]
    return spark.createDataFrame(data, "id long, score double, grp string, w long").repartition(6).cache(), data


@WAYS
@pytest.mark.parametrize("descending", [True, False])
def test_row_positions(table, options, descending):
    df, data = table
    got = {r["id"]: r["position"] for r in ranking.row_positions(df, "score", "id", descending, **options).collect()}
    present = sorted((d for d in data if d[1] is not None), key=lambda d: ((-d[1] if descending else d[1]), d[0]))
    want = {d[0]: i + 1 for i, d in enumerate(present)}
    want[1500] = len(data)
    assert got == want


@WAYS
def test_positions_with_two_scores_only(spark, options):
    data = [(i, float(i % 3 == 0)) for i in range(900)]
    df = spark.createDataFrame(data, "id long, score double")
    got = {r["id"]: r["position"] for r in ranking.row_positions(df, "score", "id", **options).collect()}
    assert got == {d[0]: i + 1 for i, d in enumerate(sorted(data, key=lambda d: (-d[1], d[0])))}


def test_hot_score_is_spread(spark):
    """No range of a table with one constant score holds more than a small part of the rows."""
    df = spark.range(4000).withColumn("score", F.lit(1.0))
    edges = ranking.percent_points(df, "score", 50)
    assert len(set(edges)) == 1 and len(edges) == 49
    plan = ranking.row_positions(df, "score", "id", rows_per_range=80)
    assert plan.select(F.max("position")).first()[0] == 4000


@WAYS
@pytest.mark.parametrize("n", [3, 10, 7])
def test_tiles(table, options, n):
    df, data = table
    got = {r["id"]: r["bucket"] for r in ranking.tiles(df, "score", "id", n, **options).collect()}
    present = sorted((d for d in data if d[1] is not None), key=lambda d: (-d[1], d[0])) + [data[1500]]
    size, extra = divmod(len(present), n)
    want, at = {}, 0
    for bucket in range(1, n + 1):
        for d in present[at:at + size + (bucket <= extra)]:
            want[d[0]] = bucket
        at += size + (bucket <= extra)
    assert got == want


@WAYS
@pytest.mark.parametrize("by", [[], ["grp"]])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(table, options, by, descending):
    df, data = table
    got = ranking.running_totals(df, "score", {"n": F.lit(1), "w": F.col("w")}, by, descending, **options).collect()
    for row in got:
        mine = [d for d in data if d[1] is not None and (not by or d[2] == row["grp"])]
        upto = [d for d in mine if (d[1] >= row["score"] if descending else d[1] <= row["score"])]
        assert row["n"] == sum(d[1] == row["score"] for d in mine)
        assert (row["cum_n"], row["cum_w"]) == (len(upto), sum(d[3] for d in upto))
    assert len(got) == len({(d[1], d[2] if by else 0) for d in data if d[1] is not None})


@pytest.mark.parametrize("options", [{}, {"direct_rows": 0}, {**LARGE, "direct_rows": 0, "max_groups": 0}], ids=["direct", "brackets", "ranges"])
@pytest.mark.parametrize("by", [[], ["grp"]])
def test_quantile_table(table, options, by):
    df, data = table
    qs = [0.0, 0.1, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0]
    got = ranking.quantile_table(df, "score", qs, by, **options).collect()
    groups = {d[2] if by else 0 for d in data if d[1] is not None}
    assert len(got) == len(qs) * len(groups)
    for row in got:
        mine = [d[1] for d in data if d[1] is not None and (not by or d[2] == row["grp"])]
        assert row["value"] == pytest.approx(np.quantile(mine, row["q"]), abs=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert ranking.quantiles(df, "x", [0.5]) == [None]
    assert ranking.quantiles(df, "x", [0.5], direct_rows=0) == [None]
    assert ranking.quantiles(df, "x", [0.5], direct_rows=0, max_groups=0, **LARGE) == [None]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_quantiles_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    direct = ranking.quantiles(df, "x", [0.2, 0.5, 0.9])
    ranged = ranking.quantiles(df, "x", [0.2, 0.5, 0.9], direct_rows=0, max_groups=0, rows_per_range=3)
    assert ranking.quantiles(df, "x", [0.2, 0.5, 0.9], direct_rows=0) == pytest.approx(direct)
    assert direct == pytest.approx(list(np.quantile(values, [0.2, 0.5, 0.9])))
    assert ranged == pytest.approx(direct)


def test_brackets_on_many_values(spark):
    """More rows than the sketch keeps: brackets hold a few values each and the result is still exact."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=60_000), np.full(30_000, 0.25)])
    df = spark.createDataFrame(__import__("pandas").DataFrame({"x": x, "g": np.arange(len(x)) % 3})).repartition(8)
    qs = [0.0, 0.001, 0.3, 0.31, 0.5, 0.9999, 1.0]
    assert ranking.quantiles(df, "x", qs, direct_rows=0) == pytest.approx(list(np.quantile(x, qs)), abs=1e-12)
    for row in ranking.quantile_table(df, "x", qs, ["g"], direct_rows=0).collect():
        assert row["value"] == pytest.approx(np.quantile(x[np.arange(len(x)) % 3 == row["g"]], row["q"]), abs=1e-12)


def test_hot_value_does_not_join_the_others(spark):
    """95 % of all rows have one score; the ranges of the other, distinct scores stay even."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 20 < 19, 0.0).otherwise(F.col("id") / 7.0).alias("score"))
    values = df.groupBy("score").count()
    edges = sorted(set(ranking.percent_points(values, "score", 20)))
    sizes = [r["count"] for r in ranking.into_ranges(values, "score", edges, "r").groupBy("r").count().collect()]
    assert len(sizes) >= 19 and max(sizes) <= 2 * 1001 / 20
    totals = ranking.running_totals(df, "score", {"n": F.lit(1)}, rows_per_range=50)
    assert totals.agg(F.max("cum_n")).first()[0] == 20_000
