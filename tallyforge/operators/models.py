"""Distributed model fits, variable selection and scoring on ``pyspark.ml``.

The driver sees coefficients and p-by-p matrices only; every pass over rows is a Spark job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import logit

FEATURES = "features"
PAIRWISE_COLUMNS = 12


@dataclass(frozen=True)
class LinearFit:
    """Coefficients (intercept last) with standard errors and p-values, and what goes with them."""

    kind: str
    names: list[str]
    coefficients: list[float]
    std_errors: list[float]
    p_values: list[float]
    measures: dict[str, float]

    def table(self, df: DataFrame, digits: int = 6) -> DataFrame:
        rows = [(n, round(c, digits), round(s, digits), round(p, digits)) for n, c, s, p in
                zip([*self.names, "(intercept)"], self.coefficients, self.std_errors, self.p_values)]
        return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, p_value double")


def _floats(values: Sequence) -> list[float]:
    return [float(v) for v in values]


def complete(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Rows without a missing predictor: what models are fitted on. Scoring returns all rows, incomplete ones with null."""
    return df.dropna(subset=list(xs))


def assembler(xs: Sequence[str], out: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(xs), outputCol=out, handleInvalid="keep")


def with_features(df: DataFrame, xs: Sequence[str], out: str = FEATURES) -> DataFrame:
    """Complete rows with their predictors as one vector."""
    return assembler(xs, out).transform(complete(df, xs))


def array_features(df: DataFrame, column: str, out: str = FEATURES) -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


@dataclass(frozen=True)
class Gram:
    """Row count, means and centred cross products of named columns."""

    names: list[str]
    rows: int
    means: np.ndarray
    cross: np.ndarray


def gram(df: DataFrame, columns: Sequence[str]) -> Gram:
    """Moments of the complete rows in two passes: means, then products of the centred columns.

    The products of few columns are plain sums inside the JVM. With more, each task sums its Arrow batches into a
    small matrix; those are added up entry by entry on the executors. Only p-by-p numbers are collected.
    """
    columns = list(columns)
    df = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    p = len(columns)
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(p)]).first()
    rows = first["n"]
    if not rows:
        raise ValueError("no complete rows")
    centre, cross = np.array([first[f"m{i}"] for i in range(p)]), np.zeros((p, p))
    if p <= PAIRWISE_COLUMNS:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        off = [F.col(f"c{i}") - float(centre[i]) for i in range(p)]
        for (i, j), v in zip(pairs, df.agg(*[F.sum(off[i] * off[j]) for i, j in pairs]).first()):
            cross[i, j] = cross[j, i] = v
    else:
        def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((p, p))
            for part in parts:
                x = part.to_numpy(dtype=float) - centre
                total += x.T @ x
            i, j = np.indices((p, p))
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

        summed = df.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        for row in summed.collect():
            cross[row["i"], row["j"]] = row["v"]
    return Gram(columns, rows, centre, cross)


def fit_ols(df: DataFrame, y: str, xs: Sequence[str]) -> LinearFit:
    """Ordinary least squares by the normal equations: one pass over the complete rows."""
    return _solve(gram(df, [y, *xs]), list(xs))


def _solve(moments: Gram, xs: list[str]) -> LinearFit:
    """Least squares of the first column on ``xs`` from centred cross products; small matrices only."""
    at = [moments.names.index(x) for x in xs]
    cross, means, rows = moments.cross, moments.means, moments.rows
    inverse = np.linalg.pinv(cross[np.ix_(at, at)], hermitian=True)
    beta = inverse @ cross[at, 0]
    total = float(cross[0, 0])
    rss = max(total - float(beta @ cross[at, 0]), 0.0)
    freedom = rows - len(xs) - 1
    sigma2 = rss / freedom if freedom > 0 else math.nan
    m = means[at]
    errors = np.sqrt(np.append(np.diag(inverse) * sigma2, sigma2 * (1 / rows + m @ inverse @ m)))
    estimates = np.append(beta, means[0] - beta @ m)
    with np.errstate(divide="ignore", invalid="ignore"):
        p_values = [two_sided_p(float(t), freedom) for t in estimates / errors]
    r2 = 1 - rss / total if total else math.nan
    return LinearFit("ols", xs, _floats(estimates), _floats(errors), p_values,
                     {"r2": r2, "r2_adjusted": 1 - (1 - r2) * (rows - 1) / freedom if freedom > 0 else math.nan,
                      "rss": rss, "rows": rows})


def two_sided_p(t: float, freedom: int) -> float:
    """Two-sided p-value of a t statistic, by the continued fraction of the incomplete beta function."""
    if math.isnan(t) or freedom <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(x, a, b) / a
    return 1 - front * _beta_fraction(1 - x, b, a) / b


def _beta_fraction(x: float, a: float, b: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    result = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            result *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return result


def fit_logit(df: DataFrame, y: str, xs: Sequence[str]) -> LinearFit:
    """Binomial logistic regression of a 0/1 column, with AIC and deviance; raises ``logit.NotConverged`` without a maximum.

    Equal rows are counted first, so each pass reads distinct ones only.
    """
    return _linear(logit.fit_sets(logit.patterns(df, y, xs), [xs])[0])


def _linear(fit: logit.Fit) -> LinearFit:
    return LinearFit("logit", fit.names, _floats(fit.coefficients), _floats(fit.errors), fit.p_values,
                     {"aic": fit.aic, "deviance": -2 * fit.likelihood})


def linear_score(fit: LinearFit) -> Column:
    """The fitted value as a plain column expression, so scoring stays inside generated code."""
    eta = F.lit(float(fit.coefficients[-1]))
    for name, c in zip(fit.names, fit.coefficients):
        eta = eta + F.lit(float(c)) * F.col(name)
    return eta if fit.kind == "ols" else 1 / (1 + F.exp(-eta))


def score(model: Model, df: DataFrame, out: str = "p", positive: int = 1) -> DataFrame:
    """Class probability of the positive class and predicted class; every row of ``df`` comes back, null where a predictor is."""
    scored = model.transform(df)
    first = model.stages[0] if hasattr(model, "stages") else None
    known = F.lit(True)
    for x in first.getInputCols() if isinstance(first, VectorAssembler) else []:
        known = known & F.col(x).isNotNull()
    if "probability" in scored.columns:
        scored = scored.withColumn(out, F.when(known, F.get(vector_to_array("probability"), F.lit(positive))))
    return scored.withColumn("prediction", F.when(known, F.col("prediction")))


def vif_values(moments: Gram, xs: Sequence[str]) -> dict[str, float]:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    at = [moments.names.index(x) for x in xs]
    cross = moments.cross[np.ix_(at, at)]
    scale = np.sqrt(np.diag(cross))
    scale[scale == 0] = 1.0
    return {x: float(v) for x, v in zip(xs, np.diag(np.linalg.pinv(cross / np.outer(scale, scale), hermitian=True)))}


def vif(df: DataFrame, xs: Sequence[str], digits: int = 5) -> DataFrame:
    rows = [(x, round(v, digits)) for x, v in vif_values(gram(df, xs), xs).items()]
    return df.sparkSession.createDataFrame(rows, "term string, vif double")


def _ols_aic(moments: Gram, names: Sequence[str]) -> float:
    rss = _solve(moments, list(names)).measures["rss"] if names else float(moments.cross[0, 0])
    return moments.rows * math.log(max(rss, 1e-300) / moments.rows) + 2 * (len(names) + 1)


def step_aic(df: DataFrame, y: str, xs: Sequence[str], kind: str = "ols") -> list[dict]:
    """Stepwise selection in both directions from the full model; each step lowers the criterion most.

    Least squares needs one pass in total, whatever the number of candidates. Logistic candidates of a step are fitted together, a
    pass per Newton step.
    """
    xs = list(xs)
    if kind == "ols":
        moments = gram(df, [y, *xs])
        return _search(xs, lambda sets: [_ols_aic(moments, names) for names in sets])
    held = logit.patterns(df, y, xs)
    return _search(xs, lambda sets: [fit.aic for fit in logit.fit_sets(held, sets)])


def _search(xs: list[str], criteria: Callable[[list[list[str]]], list[float]]) -> list[dict]:
    chosen = list(xs)
    current = criteria([chosen])[0]
    path = [{"step": 0, "action": "start", "term": "", "aic": current, "terms": list(chosen)}]
    while xs:
        sets = [[n for n in xs if (n in chosen) != (n == x)] for x in xs]
        best, at = min((value, i) for i, value in enumerate(criteria(sets)))
        if best >= current - 1e-9:
            break
        action = "drop" if xs[at] in chosen else "add"
        current, chosen = best, sets[at]
        path.append({"step": len(path), "action": action, "term": xs[at], "aic": current, "terms": list(chosen)})
    return path


def eliminate(df: DataFrame, y: str, xs: Sequence[str], kind: str = "ols", vif_max: float = 2.0,
              p_max: float = 0.05) -> tuple[LinearFit, list[dict]]:
    """Drop the variable with the largest inflation factor above ``vif_max`` that is not significant, else
    the least significant one, and refit until all are significant and inflation is within bounds.

    Inflation, and for least squares every refit as well, comes from the moments of one pass; a logistic refit takes a pass over
    the counted patterns per Newton step.
    """
    names = list(xs)
    moments = gram(df, [y, *names])
    held = logit.patterns(df, y, names) if kind != "ols" else None
    path: list[dict] = []
    while True:
        fit = _solve(moments, list(names)) if held is None else _linear(logit.fit_sets(held, [names])[0])
        p = dict(zip(names, fit.p_values))
        inflated = {x: v for x, v in vif_values(moments, names).items() if v > vif_max}
        weak = {x: v for x, v in p.items() if not v <= p_max}
        both = [x for x in inflated if x in weak]
        if len(names) == 1 or not (inflated or weak):
            return fit, path
        if both:
            term, why = max(both, key=inflated.get), "vif and p"
        elif weak:
            term, why = max(weak, key=weak.get), "p"
        else:
            term, why = max(inflated, key=inflated.get), "vif"
        path.append({"step": len(path) + 1, "term": term, "reason": why, "vif": inflated.get(term),
                     "p_value": p[term]})
        names.remove(term)


def fit_tree(df: DataFrame, y: str, xs: Sequence[str], min_leaf: int = 10, min_gain: float = 0.0, max_depth: int = 5,
             seed: int = 100) -> Model:
    tree = DecisionTreeClassifier(labelCol=y, featuresCol=FEATURES, minInstancesPerNode=min_leaf, minInfoGain=min_gain,
                                  maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[assembler(xs), tree]).fit(complete(df, [y, *xs]))


def fit_forest(df: DataFrame, y: str, xs: Sequence[str], trees: int = 50, per_split: int = 5, max_depth: int = 5,
               seed: int = 100) -> Model:
    forest = RandomForestClassifier(labelCol=y, featuresCol=FEATURES, numTrees=trees, maxDepth=max_depth, seed=seed,
                                    featureSubsetStrategy=str(min(per_split, len(xs))))
    return Pipeline(stages=[assembler(xs), forest]).fit(complete(df, [y, *xs]))


def importances(model: Model, xs: Sequence[str], df: DataFrame, digits: int = 6) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(x, round(float(v), digits)) for x, v in zip(xs, values)],
                                           "term string, importance double")


def svm(rows: int, c: float = 1.0, classes: int = 2, y: str = "label", features: str = FEATURES, max_iter: int = 50,
        parallelism: int = 4) -> Estimator:
    """Linear support vector machine; more than two classes are fitted one against the rest.

    ``c`` weighs errors against the margin as in the usual formulation; per row that is a penalty of ``1 / (c * rows)``.
    """
    binary = LinearSVC(labelCol=y, featuresCol=features, regParam=1.0 / (c * max(rows, 1)), maxIter=max_iter)
    if classes == 2:
        return binary
    return OneVsRest(classifier=binary, labelCol=y, featuresCol=features, parallelism=parallelism)


def fit_svm(df: DataFrame, y: str, features: str = FEATURES, c: float = 1.0, classes: int = 2,
            max_iter: int = 50) -> Model:
    return svm(df.count(), c, classes, y, features, max_iter).fit(df)


def rff(df: DataFrame, x: str, gamma: float, dims: int, width: int, out: str = FEATURES, seed: int = 0) -> DataFrame:
    """Random Fourier features: inner products approach ``exp(-gamma * squared distance)``.

    The projection has ``width * dims`` numbers whatever the number of rows, and travels with the tasks.
    """
    rng = np.random.default_rng(seed)
    directions = rng.normal(scale=math.sqrt(2 * gamma), size=(width, dims))
    phase = rng.uniform(0, 2 * math.pi, size=dims)
    factor = math.sqrt(2 / dims)

    @F.pandas_udf("array<double>")
    def project(values: pd.Series) -> pd.Series:
        points = np.array(values.tolist(), dtype=float).reshape(len(values), width)
        return pd.Series(list(factor * np.cos(points @ directions + phase)))

    return df.withColumn(out, array_to_vector(project(F.col(x).cast("array<double>"))))


def polynomial_stages(x: str, width: int, degree: int = 2, out: str = FEATURES) -> list:
    """Reduce to ``width`` principal components, scale, and expand to all products up to ``degree``."""
    return [PCA(k=width, inputCol=x, outputCol="_reduced"),
            StandardScaler(withMean=True, inputCol="_reduced", outputCol="_scaled"),
            PolynomialExpansion(degree=degree, inputCol="_scaled", outputCol=out)]


def grid_search(estimator: Estimator, grid: Mapping[object, Sequence], df: DataFrame, evaluator: Evaluator,
                folds: int = 3, parallelism: int = 4, seed: int = 100) -> tuple[Model, list[dict]]:
    """Cross-validated grid search; folds and settings run side by side on the executors."""
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(param, list(values))
    maps = builder.build()
    search = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds,
                            parallelism=parallelism, seed=seed).fit(df)
    table = [{**{p.name: v for p, v in m.items()}, "metric": metric} for m, metric in zip(maps, search.avgMetrics)]
    return search.bestModel, table


def accuracy(y: str = "label") -> Evaluator:
    return MulticlassClassificationEvaluator(labelCol=y, predictionCol="prediction", metricName="accuracy")
