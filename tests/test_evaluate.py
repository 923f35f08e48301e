"""Evaluation, score card and profit, including figures that can be checked by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import evaluate

LARGE = {"rows_per_range": 30}


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(800) < 0.2).astype(int)
    p = np.clip(np.where(rng.random(800) < 0.3, 0.5, rng.random(800) * 0.7 + 0.3 * y), 0, 1).round(2)
    df = spark.createDataFrame([(int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id int, y int, p double")
    return df.repartition(4).cache(), y, p


def curve(y, p):
    cuts = sorted(set(p), reverse=True)
    return [((p >= c)[y == 1].mean(), (p >= c)[y == 0].mean()) for c in cuts]


@pytest.mark.parametrize("options", [{}, LARGE], ids=["direct", "ranges"])
def test_ks_and_auc(scored, options):
    df, y, p = scored
    assert evaluate.ks(df, "y", "p", **options).first()[0] == pytest.approx(max(a - b for a, b in curve(y, p)), abs=1e-6)
    pos, neg = p[y == 1], p[y == 0]
    pairs = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert evaluate.auc(df, "y", "p", **options).first()[0] == pytest.approx(pairs / (len(pos) * len(neg)), abs=1e-6)


def test_class_versions(scored):
    """On hard classes KS is sens + spec - 1 and AUC their mean."""
    df, _, _ = scored
    hard = df.withColumn("c", evaluate.on_class("p", 0.4)).withColumn("said", F.col("c").cast("int"))
    m = evaluate.confusion(hard, "y", "said", 1, digits=9).first()
    assert evaluate.ks(hard, "y", "c").first()[0] == pytest.approx(m["sensitivity"] + m["specificity"] - 1, abs=1e-5)
    assert evaluate.auc(hard, "y", "c").first()[0] == pytest.approx((m["sensitivity"] + m["specificity"]) / 2, abs=1e-5)
    assert 0.7536 + 0.7482 - 1 == pytest.approx(0.5018)


def test_sweep_and_cutoff(scored):
    df, y, p = scored
    cuts = [0.01 + 0.98 * i / 99 for i in range(100)]
    sweep = evaluate.threshold_sweep(df, "y", "p", cuts)
    got = {r["cutoff"]: r for r in sweep.collect()}
    assert len(got) == 100
    for c in cuts:
        said = p >= c
        assert got[c]["sensitivity"] == pytest.approx(said[y == 1].mean(), abs=1e-6)
        assert got[c]["specificity"] == pytest.approx((~said)[y == 0].mean(), abs=1e-6)
        assert got[c]["accuracy"] == pytest.approx((said == y).mean(), abs=1e-6)
    best = evaluate.best_cutoff(sweep).first()
    assert abs(best["sensitivity"] - best["specificity"]) == pytest.approx(
        min(abs(r["sensitivity"] - r["specificity"]) for r in got.values()))


@pytest.mark.parametrize("options", [{}, LARGE], ids=["direct", "ranges"])
def test_gain_lift(scored, options):
    df, y, p = scored
    table = [r.asDict() for r in evaluate.gain_lift(df, "y", "p", "id", 10, **options).orderBy("tile").collect()]
    best = y[np.lexsort((np.arange(len(p)), -p))]
    assert [r["rows_in"] for r in table] == [80] * 10
    assert [r["events_in"] for r in table] == [int(best[i * 80:(i + 1) * 80].sum()) for i in range(10)]
    assert [r["captured"] for r in table] == [round(best[:i * 80 + 80].sum() / best.sum(), 4) for i in range(10)]
    assert [r["lift"] for r in table] == [round(best[:i * 80 + 80].mean() / best.mean(), 4) for i in range(10)]


def test_confusion_multi(spark):
    data = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)]
    got = {r["class"]: r for r in evaluate.confusion_multi(spark.createDataFrame(data, "y int, z int"), "y", "z").collect()}
    assert (got["0"]["sensitivity"], got["0"]["specificity"]) == (0.5, pytest.approx(2 / 3, abs=1e-6))
    assert (got["1"]["sensitivity"], got["2"]["sensitivity"], got["2"]["specificity"]) == (1.0, 0.0, 1.0)


def test_scorecard(spark):
    assert evaluate.points_at(0.3960606) == pytest.approx(345.7351, abs=1e-4)
    df = spark.createDataFrame([(0.1,), (0.3960606,), (0.9,)], "p double")
    points = [r["score"] for r in evaluate.scorecard(df, "p").orderBy("p").collect()]
    assert points == sorted(points, reverse=True) and points[1] == pytest.approx(345.7351, abs=1e-4)
    assert evaluate.points_at(1 / 11) == pytest.approx(400) and evaluate.points_at(1 / 21) == pytest.approx(420)
    decided = evaluate.decide(evaluate.scorecard(df, "p"), evaluate.points_at(0.3960606) - 1e-9)
    assert [r["decision"] for r in decided.orderBy("p").collect()] == ["accept", "accept", "reject"]


def test_profit(spark):
    cells = spark.createDataFrame([(1, 0, 1805), (0, 0, 23969), (1, 1, 1142), (0, 1, 42951)], "bad int, ok int, n int")
    rows = cells.select("bad", "ok", F.explode(F.sequence(F.lit(1), "n")))
    got = evaluate.profit_impact(rows, F.col("bad") == 1, F.col("ok") == 1).first()
    assert (got["profit_without"], got["profit_with"], got["loss_avoided"]) == (1922165.0, 2361635.0, 2707500.0)
    assert got["gain_pct"] == pytest.approx(22.8633, abs=1e-3)


def test_regression_measures(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)], "y double, z double")
    want = np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1] ** 2
    assert evaluate.r2_corr(df, "y", "z").first()[0] == pytest.approx(want, abs=1e-6)
    assert sorted(r["residual"] for r in evaluate.residuals(df, "y", "z").collect()) == [-4.0, -2.0, -1.0]
    gap = evaluate.r2_gap(df.withColumn("t", F.lit(True)).union(df.withColumn("t", F.lit(False))), "y", "z", F.col("t")).first()
    assert (gap["gap"], gap["within_limit"]) == (0.0, True)
    both = evaluate.compare_models({"a": evaluate.r2_corr(df, "y", "z"), "b": evaluate.r2_corr(df, "y", "y")})
    assert {r["model"] for r in both.collect()} == {"a", "b"}
