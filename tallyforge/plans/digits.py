"""Ten-class recognition of vectors. Embeddings with their label 0-9 stand in for images of digits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import evaluate, kernels, machines, models, prep, sampling
from tallyforge.plans.registry import Tables, query
from tallyforge.session import materialise

WIDTH = 64


def images(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("embedding").alias("x"), F.col("label").cast("double").alias("label"))


def split_images(t: Tables) -> tuple[DataFrame, DataFrame]:
    parts = sampling.split(images(t), "vec_id", 0.7, 9)
    return parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")


@query("rescaled_minmax", """
WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, round(min((x + 1) / 2), 6) AS min_value, round(max((x + 1) / 2), 6) AS max_value,
round(avg((x + 1) / 2), 6) AS avg_value FROM v GROUP BY 1""")
def rescaled_minmax(t: Tables) -> DataFrame:
    scaled = prep.rescale_array(t.embeddings, "embedding", -1.0, 1.0)
    cells = scaled.select("label", F.explode("embedding").alias("x"))
    return cells.groupBy("label").agg(F.round(F.min("x"), 6).alias("min_value"), F.round(F.max("x"), 6).alias("max_value"),
                                      F.round(F.avg("x"), 6).alias("avg_value"))


#: Ten sums over all coordinates, one for each remainder of their position; the largest names a class that can be learned.
SQL_SUMS = """list_transform(range(10), lambda c: list_sum(list_transform(list_filter(range(64), lambda i: i % 10 = c),
lambda i: embedding[i + 1]::DOUBLE)))"""


def largest_sum(embedding: str) -> Column:
    sums = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.aggregate(
        F.filter(embedding, lambda x, i: i % 10 == c), F.lit(0.0), lambda total, x: total + x.cast("double")))
    return (F.array_position(sums, F.array_max(sums)) - 1).cast("int")


@query("multiclass_metrics", f"""
WITH s AS (SELECT label, {SQL_SUMS} AS sums FROM embeddings),
p AS (SELECT label, list_position(sums, list_max(sums)) - 1 AS pred FROM s),
k AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT pred FROM p)
SELECT c::VARCHAR AS class, count(*) FILTER (WHERE label = c)::BIGINT AS n_actual, count(*) FILTER (WHERE pred = c)::BIGINT AS n_predicted,
count(*) FILTER (WHERE label = c AND pred = c)::BIGINT AS tp,
round(count(*) FILTER (WHERE label = c AND pred = c)::DOUBLE / count(*) FILTER (WHERE label = c), 6) AS sensitivity,
round(count(*) FILTER (WHERE label <> c AND pred <> c)::DOUBLE / count(*) FILTER (WHERE label <> c), 6) AS specificity
FROM p, k GROUP BY c""")
def multiclass_metrics(t: Tables) -> DataFrame:
    guesses = t.embeddings.select("label", largest_sum("embedding").alias("pred"))
    return evaluate.confusion_multi(guesses, "label", "pred")


def accuracy_table(name: str, predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_rows"),
                           F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 4).alias("accuracy"))


@query("linear_svm_learns", f"""
SELECT 'linear' AS model, count(*)::BIGINT AS n_rows, true AS learned FROM embeddings
WHERE left(md5(vec_id::VARCHAR || ':9'), 8) >= '{sampling.share_of_hashes(0.7)}'""")
def linear_svm_learns(t: Tables) -> DataFrame:
    """Two classes, by the larger of the sums over even and odd positions of all 64 inputs: whether three in four held-out rows or more
    are named rightly. Ten such classes take more rows than the smaller tables have."""
    def side(start: int) -> Column:
        return F.aggregate(F.filter("x", lambda x, i: i % 2 == start), F.lit(0.0), lambda total, x: total + x.cast("double"))

    train, test = (models.array_features(part.withColumn("label", (side(0) > side(1)).cast("double")), "x") for part in split_images(t))
    train = materialise(train, "digits")
    found = accuracy_table("linear", models.fit_svm(train, "label", c=1.0).transform(test))
    return found.select("model", "n_rows", (F.col("accuracy") >= 0.75).alias("learned"))


# --- ten classes that can be learned: which of ten sums over all inputs is largest ----------------------------------

#: The least share of right answers that counts as learned; guessing reaches 0.1, the smallest table 0.3 and more.
LEARNED = 0.25
FOLDS = 3
PENALTIES = [2.0 ** k for k in range(-5, 6)]
DEGREES, SCALES, POLY_PENALTIES = [1, 2, 3], [0.1, 0.5], [0.5, 4.0]
WIDTHS, RBF_PENALTIES = [0.01, 0.1, 0.5], [0.5, 1.0, 4.0]
SQL_TEST = f"embeddings WHERE left(md5(vec_id::VARCHAR || ':9'), 8) >= '{sampling.share_of_hashes(0.7)}'"


def ten_sums(t: Tables) -> DataFrame:
    """``vec_id, x, label, fold, part`` of all rows, written."""
    rows = sampling.split(images(t), "vec_id", 0.7, 9).withColumn("label", largest_sum("x"))
    return materialise(rows.withColumn("fold", machines.fold_of(F.col("vec_id"), FOLDS)), "digits")


def answered(name: str, rows: DataFrame, block: int = 0, c: float = 1.0) -> DataFrame:
    """Whether machines of one setting, fitted on the training rows, converged and name enough held-out rows rightly."""
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    width = len(rows.first()["x"])
    fitted = machines.fit(train, machines.grid(range(10), [c], [slice(0, width)]))
    found = accuracy_table(name, machines.predicted(test, fitted, block, c))
    return found.select("model", "n_rows", F.lit(bool(fitted.converged.all())).alias("converged"),
                        (F.col("accuracy") >= LEARNED).alias("learned"))


def grid_rows(t: Tables, table: list[dict], names: list[str], values) -> DataFrame:
    rows = [(*values(r["block"]), r["c"], r["n"], r["converged"], r["accuracy"] >= LEARNED) for r in table]
    return t.spark.createDataFrame(rows, ", ".join([*names, "c double, n_rows bigint, converged boolean, learned boolean"]))


@query("linear_svm_accuracy", f"SELECT 'linear' AS model, count(*)::BIGINT AS n_rows, true AS converged, true AS learned FROM {SQL_TEST}")
def linear_svm_accuracy(t: Tables) -> DataFrame:
    return answered("linear", ten_sums(t))


@query("rff_svm_accuracy", f"SELECT 'rbf' AS model, count(*)::BIGINT AS n_rows, true AS converged, true AS learned FROM {SQL_TEST}")
def rff_svm_accuracy(t: Tables) -> DataFrame:
    wide = models.rff(ten_sums(t), "x", 0.1, 256, WIDTH, seed=5).withColumn("x", vector_to_array("features"))
    return answered("rbf", materialise(wide.select("label", "fold", "part", "x"), "digits"), c=16.0)


@query("grid_search_table", f"""
SELECT unnest({PENALTIES})::DOUBLE AS c, n_rows, true AS converged, true AS learned FROM (SELECT count(*)::BIGINT AS n_rows FROM embeddings)""")
def grid_search_table(t: Tables) -> DataFrame:
    """Eleven penalties, three folds and ten classes over all inputs, fitted in the same passes."""
    rows = ten_sums(t)
    fitted = machines.fit(rows, machines.grid(range(10), PENALTIES, [slice(0, WIDTH)], FOLDS))
    return grid_rows(t, machines.cross_validated(rows, fitted), [], lambda _: ())


def polynomials() -> list[kernels.Polynomial]:
    return [kernels.Polynomial(WIDTH, d, s, 1.0, 192, seed=5) for d in DEGREES for s in SCALES]


@query("poly_svm_accuracy", f"""
SELECT degree, scale, c, n_rows, true AS converged, true AS learned FROM (SELECT count(*)::BIGINT AS n_rows FROM embeddings),
(SELECT unnest({DEGREES})::INT AS degree), (SELECT unnest({SCALES})::DOUBLE AS scale), (SELECT unnest({POLY_PENALTIES})::DOUBLE AS c)""")
def poly_svm_accuracy(t: Tables) -> DataFrame:
    """Polynomial kernels of all inputs by tensor sketch: degree, scale and penalty by cross-validation, fitted in the same passes."""
    rows, maps = ten_sums(t), polynomials()
    wide = materialise(kernels.mapped(rows, "x", maps, ["label", "fold"]), "digits")
    fitted = machines.fit(wide, machines.grid(range(10), POLY_PENALTIES, kernels.blocks(maps), FOLDS))
    return grid_rows(t, machines.cross_validated(wide, fitted), ["degree int", "scale double"], lambda b: (maps[b].degree, maps[b].scale))


@query("poly_kernel_error", f"""
SELECT degree, scale, n_pairs, true AS within_bound FROM (SELECT count(*)::BIGINT AS n_pairs FROM embeddings),
(SELECT unnest({DEGREES})::INT AS degree), (SELECT unnest({SCALES})::DOUBLE AS scale)""")
def poly_kernel_error(t: Tables) -> DataFrame:
    """Whether the mean squared error of the sketched kernel over pairs of rows is within the bound stated for it."""
    maps = polynomials()
    rows = [(m.degree, m.scale, e["pairs"], bool(e["error"] <= e["bound"])) for m, e in zip(maps, kernels.errors(images(t), "x", maps))]
    return t.spark.createDataFrame(rows, "degree int, scale double, n_pairs bigint, within_bound boolean")


def radial(rows: DataFrame) -> list[kernels.Landmarks]:
    points = kernels.landmark_rows(rows, "vec_id", "x", 192, seed=5)
    return [kernels.landmarks(points, g) for g in WIDTHS]


@query("rbf_svm_grid", f"""
SELECT gamma, c, n_rows, true AS converged, true AS learned FROM (SELECT count(*)::BIGINT AS n_rows FROM embeddings),
(SELECT unnest({WIDTHS})::DOUBLE AS gamma), (SELECT unnest({RBF_PENALTIES})::DOUBLE AS c)""")
def rbf_svm_grid(t: Tables) -> DataFrame:
    """Radial kernels by landmarks: width and penalty by cross-validation, fitted in the same passes."""
    rows = ten_sums(t)
    maps = radial(rows)
    wide = materialise(kernels.mapped(rows, "x", maps, ["label", "fold"]), "digits")
    fitted = machines.fit(wide, machines.grid(range(10), RBF_PENALTIES, kernels.blocks(maps), FOLDS))
    return grid_rows(t, machines.cross_validated(wide, fitted), ["gamma double"], lambda b: (maps[b].gamma,))


@query("rbf_kernel_error", f"""
SELECT gamma, n_pairs, true AS within_bound FROM (SELECT count(*)::BIGINT AS n_pairs FROM embeddings), (SELECT unnest({WIDTHS})::DOUBLE AS gamma)""")
def rbf_kernel_error(t: Tables) -> DataFrame:
    """Whether the landmark kernel is off by less than 0.05, root mean square over pairs of rows; the kernel itself is at most 1."""
    rows = images(t)
    maps = radial(rows)
    found = [(m.gamma, e["pairs"], bool(e["error"] <= 0.05 ** 2)) for m, e in zip(maps, kernels.errors(rows, "x", maps))]
    return t.spark.createDataFrame(found, "gamma double, n_pairs bigint, within_bound boolean")
