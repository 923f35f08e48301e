"""Fits against closed forms, MLlib and known coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tallyforge.operators import models

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3)) + [5, -2, 0]
    x[:, 2] = 0.9 * x[:, 0] + 0.3 * x[:, 2]
    y = 3 + 2 * x[:, 0] - 1.5 * x[:, 1] + rng.normal(size=600)
    label = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 5 + x[:, 1] + 2)))).astype(float)
    frame = pd.DataFrame(np.column_stack([x, y, label, rng.normal(size=600)]), columns=[*XS, "y", "label", "noise"])
    return spark.createDataFrame(frame).repartition(4).cache(), frame


@pytest.mark.parametrize("pairwise", [12, 0], ids=["sums", "batches"])
def test_ols_matches_mllib(data, monkeypatch, pairwise):
    monkeypatch.setattr(models, "PAIRWISE_COLUMNS", pairwise)
    df, _ = data
    fit = models.fit_ols(df, "y", XS)
    vector = models.with_features(df, XS)
    other = LinearRegression(labelCol="y", featuresCol="features", solver="normal").fit(vector)
    s = other.summary
    assert fit.coefficients == pytest.approx([*other.coefficients, other.intercept], rel=1e-8)
    assert fit.std_errors == pytest.approx(list(s.coefficientStandardErrors), rel=1e-8)
    assert fit.p_values == pytest.approx(list(s.pValues), rel=1e-6, abs=1e-14)
    assert (fit.measures["r2"], fit.measures["r2_adjusted"]) == pytest.approx((s.r2, s.r2adj))
    assert [r["term"] for r in fit.table(df).collect()] == ["a", "b", "c", "(intercept)"]


@pytest.mark.parametrize("t,freedom,p", [(2.0, 10, 0.0733880), (0.0, 5, 1.0), (1.0, 1, 0.5), (12.706205, 1, 0.05),
                                          (1.959964, 10**7, 0.05), (-2.0, 10, 0.0733880)])
def test_p_values(t, freedom, p):
    assert models.two_sided_p(t, freedom) == pytest.approx(p, abs=1e-6)


def test_vif(data):
    df, frame = data
    got = {r["term"]: r["vif"] for r in models.vif(df, XS).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(frame[XS].to_numpy().T)))
    assert [got[x] for x in XS] == pytest.approx(list(want), abs=1e-4)
    cube = [(float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
    flat = models.vif(df.sparkSession.createDataFrame(cube, "a double, b double, c double"), XS)
    assert [r["vif"] for r in flat.collect()] == [1.0, 1.0, 1.0]


def test_step_aic(data):
    df, _ = data
    path = models.step_aic(df, "y", [*XS, "noise"])
    values = [p["aic"] for p in path]
    assert values == sorted(values, reverse=True) and {"a", "b"} <= set(path[-1]["terms"])
    logit = models.step_aic(df, "label", ["a", "b", "noise"], "logit")
    values = [p["aic"] for p in logit]
    assert values == sorted(values, reverse=True) and {"a", "b"} <= set(logit[-1]["terms"])
    held = models.logit.patterns(df, "label", ["a"])
    none, one = models.logit.fit_sets(held, [[], ["a"]])
    assert none.aic > one.aic == pytest.approx(models.fit_logit(df, "label", ["a"]).measures["aic"])


@pytest.mark.parametrize("kind,y", [("ols", "y"), ("logit", "label")])
def test_eliminate(data, kind, y):
    df, _ = data
    fit, path = models.eliminate(df, y, [*XS, "noise"], kind)
    assert all(p <= 0.05 for p in fit.p_values[:-1]) and "noise" not in fit.names
    inflation = models.vif_values(models.gram(df, fit.names), fit.names)
    assert all(v <= 2 for v in inflation.values())
    assert len(path) == 4 - len(fit.names)


def test_logit_recovers_odds(spark):
    rows = [("u", 1)] * 30 + [("u", 0)] * 70 + [("v", 1)] * 60 + [("v", 0)] * 40
    df = spark.createDataFrame([(int(g == "v"), y) for g, y in rows], "v int, y int")
    fit = models.fit_logit(df, "y", ["v"])
    assert fit.coefficients == pytest.approx([np.log(1.5) - np.log(3 / 7), np.log(3 / 7)], abs=1e-5)
    got = {round(r[0], 5) for r in df.select(models.linear_score(fit)).distinct().collect()}
    assert got == {0.3, 0.6}


def test_trees(data):
    df, _ = data
    tree = models.fit_tree(df, "label", XS)
    scored = models.score(tree, df)
    assert scored.where("p < 0 OR p > 1").count() == 0
    assert scored.where(F.col("prediction") == F.col("label")).count() > 360
    forest = models.fit_forest(df, "label", XS, trees=5, per_split=2)
    weights = {r["term"]: r["importance"] for r in models.importances(forest, XS, df).collect()}
    assert sum(weights.values()) == pytest.approx(1, abs=1e-4)


def test_kernels(spark):
    """A ring around a blob: no line separates them, both feature maps do."""
    rng = np.random.default_rng(5)
    angle, inner = rng.uniform(0, 2 * np.pi, 150), rng.normal(scale=0.3, size=(150, 2))
    ring = np.column_stack([2 * np.cos(angle), 2 * np.sin(angle)])
    points = [([float(v) for v in p], float(i < 150)) for i, p in enumerate(np.vstack([ring, inner]))]
    df = spark.createDataFrame(points, "x array<double>, label double").cache()

    def accuracy(train, column="features"):
        model = models.fit_svm(train, "label", column, c=10.0)
        return model.transform(train).where("prediction = label").count() / 300

    linear = models.array_features(df, "x")
    assert accuracy(linear) < 0.8
    assert accuracy(models.rff(df, "x", 0.5, 64, 2)) > 0.95
    from pyspark.ml import Pipeline
    expanded = Pipeline(stages=models.polynomial_stages("features", 2, out="wide")).fit(linear).transform(linear)
    assert accuracy(expanded.select("label", "wide"), "wide") > 0.95


def test_rff_approaches_the_kernel(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([0.6, 0.8],)], "x array<double>")
    a, b = [r["features"].toArray() for r in models.rff(df, "x", 0.5, 4000, 2).collect()]
    assert a @ b == pytest.approx(np.exp(-0.5), abs=0.05)


def test_grid_search_and_classes(spark):
    rng = np.random.default_rng(6)
    data = [([float(v) for v in rng.normal(loc=3 * np.eye(3)[c], scale=0.4)], float(c)) for c in range(3) for _ in range(40)]
    df = models.array_features(spark.createDataFrame(data, "x array<double>, label double"), "x").cache()
    model = models.fit_svm(df, "label", c=10.0, classes=3)
    assert model.transform(df).where("prediction = label").count() > 110
    two = df.where("label < 2")
    svm = models.svm(two.count(), max_iter=5)
    _, table = models.grid_search(svm, {svm.regParam: [0.001, 0.1]}, two, models.accuracy(), folds=2)
    assert [set(r) for r in table] == [{"regParam", "metric"}] * 2 and all(r["metric"] > 0.9 for r in table)


def test_scoring_keeps_incomplete_rows(spark):
    rows = [(float(i % 2), float(i), None if i % 5 == 0 else float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    scored = models.score(models.fit_tree(df, "y", ["a", "b"]), df)
    assert scored.count() == 100 and scored.where("p is null").count() == scored.where("b is null").count() == 20
    assert scored.where("b is null and prediction is not null").count() == 0


def test_logit_counts_equal_rows(spark):
    rows = [(1, 0.0)] * 30 + [(0, 0.0)] * 10 + [(1, 1.0)] * 5 + [(0, 1.0)] * 15 + [(1, None)]
    fit = models.fit_logit(spark.createDataFrame(rows, "y int, x double"), "y", ["x"])
    assert fit.coefficients[1] == pytest.approx(np.log(3), abs=1e-5)
    assert fit.coefficients[0] == pytest.approx(np.log(1 / 3) - np.log(3), abs=1e-5)
    likelihood = 30 * np.log(.75) + 10 * np.log(.25) + 5 * np.log(.25) + 15 * np.log(.75)
    assert fit.measures["aic"] == pytest.approx(4 - 2 * likelihood, abs=1e-5)


def test_logit_with_counts_of_thousands(spark):
    """A saturated model: log odds, their standard errors and the likelihood in closed form."""
    cells = {0: (40_000, 9_000), 1: (25_000, 5_900), 2: (31_000, 6_800), 3: (120, 119)}
    df = spark.createDataFrame([(g, n, e) for g, (n, e) in cells.items()], "g int, n int, e int").selectExpr(
        "g", "explode(sequence(1, n)) AS i", "e").selectExpr("(i <= e)::int AS y", *[f"(g = {g})::int AS d{g}" for g in (1, 2, 3)])
    fit = models.fit_logit(df.repartition(5), "y", ["d1", "d2", "d3"])
    odds = {g: np.log(e / (n - e)) for g, (n, e) in cells.items()}
    assert fit.coefficients == pytest.approx([odds[g] - odds[0] for g in (1, 2, 3)] + [odds[0]], abs=1e-9)
    spread = {g: 1 / e + 1 / (n - e) for g, (n, e) in cells.items()}
    assert fit.std_errors == pytest.approx([np.sqrt(spread[g] + spread[0]) for g in (1, 2, 3)] + [np.sqrt(spread[0])], rel=1e-7)
    likelihood = sum(e * np.log(e / n) + (n - e) * np.log(1 - e / n) for n, e in cells.values())
    assert fit.measures["aic"] == pytest.approx(8 - 2 * likelihood, rel=1e-10)


def test_logit_of_wide_numbers_matches_mllib(spark):
    from pyspark.ml.regression import GeneralizedLinearRegression

    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(2e5, 3e4, 3000), rng.normal(0, 1e-3, 3000)])
    y = (rng.random(3000) < 1 / (1 + np.exp(-(x[:, 0] - 2e5) / 3e4 - 500 * x[:, 1]))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]})).repartition(3)
    fit = models.fit_logit(df, "y", ["a", "b"])
    other = GeneralizedLinearRegression(labelCol="y", family="binomial", tol=1e-12).fit(models.with_features(df, ["a", "b"]))
    assert fit.coefficients == pytest.approx([*other.coefficients, other.intercept], rel=1e-6)
    assert fit.std_errors == pytest.approx(other.summary.coefficientStandardErrors, rel=1e-5)
    assert fit.measures["aic"] == pytest.approx(other.summary.aic, rel=1e-9)


@pytest.mark.parametrize("rows", [[(0, 0.0)] * 9 + [(1, 1.0)] * 9, [(1, 1.0), (1, 2.0)]], ids=["separated", "one class"])
def test_logit_without_a_maximum(spark, rows):
    with pytest.raises(models.logit.NotConverged):
        models.fit_logit(spark.createDataFrame(rows, "y int, x double"), "y", ["x"])
