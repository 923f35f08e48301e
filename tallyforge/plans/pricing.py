"""Price regression. Parts stand in for cars where names and categories matter, line items where the
fit should grow with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import columns, evaluate, models, prep, sampling
from tallyforge.plans.registry import Tables, query


@query("split_first_word", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS company,
coalesce(nullif(regexp_extract(CASE WHEN p_type = 'PROMO' THEN split_part(p_name, ' ', 1) ELSE p_name END, '^[^ ]+ (.*)$', 1), ''), 'missing') AS model
FROM part""")
def split_first_word(t: Tables) -> DataFrame:
    name = F.when(F.col("p_type") == "PROMO", text.first_word("p_name")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", text.first_word("p_name").alias("company"), text.rest_after_first_word(name).alias("model"))


@query("derived_ratios", """
SELECT p_partkey, round(p_retailprice / p_size, 4) AS price_per_size, round(p_size / p_retailprice, 6) AS size_per_price,
p_size + p_partkey AS overall FROM part""")
def derived_ratios(t: Tables) -> DataFrame:
    ratios = columns.derive(t.part, {
        "price_per_size": F.round(F.try_divide("p_retailprice", "p_size"), 4),
        "size_per_price": F.round(F.try_divide("p_size", "p_retailprice"), 6),
        "overall": F.col("p_size") + F.col("p_partkey")})
    return ratios.select("p_partkey", "price_per_size", "size_per_price", "overall")


@query("ols_simple", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def ols_simple(t: Tables) -> DataFrame:
    fit = models.fit_ols(t.lineitem, "l_extendedprice", ["l_quantity"])
    slope, intercept = fit.coefficients
    return t.spark.createDataFrame([(round(slope, 4), round(intercept, 3), round(fit.measures["r2"], 6))],
                                   "slope double, intercept double, r2 double")


@query("ols_coefficients", """
WITH m AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem),
s AS (SELECT covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_discount, l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12,
  covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y FROM lineitem),
b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s)
SELECT 'l_quantity' AS term, round(b1, 3) AS estimate FROM b UNION ALL SELECT 'l_discount', round(b2, 3) FROM b
UNION ALL SELECT '(intercept)', round(my - b1 * m1 - b2 * m2, 3) FROM b, m""")
def ols_coefficients(t: Tables) -> DataFrame:
    return models.fit_ols(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"]).table(t.lineitem, 3).select(
        "term", "estimate")


@query("vif", """
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM lineitem),
d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
SELECT 'l_quantity' AS term, round((1 - c * c) / det, 5) AS vif FROM d
UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 5) FROM d UNION ALL SELECT 'l_tax', round((1 - a * a) / det, 5) FROM d""")
def vif(t: Tables) -> DataFrame:
    return models.vif(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])


def dated_lines(t: Tables) -> DataFrame:
    return t.lineitem.select("l_extendedprice", "l_quantity", "l_discount", "l_tax",
                             F.col("l_linenumber").cast("double").alias("l_linenumber"),
                             F.month("l_shipdate").cast("double").alias("ship_month"))


STEP_TERMS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "ship_month"]


@query("step_aic_path")
def step_aic_path(t: Tables) -> DataFrame:
    path = models.step_aic(dated_lines(t), "l_extendedprice", STEP_TERMS)
    rows = [(p["step"], p["action"], p["term"], round(p["aic"], 4)) for p in path]
    return t.spark.createDataFrame(rows, "step int, action string, term string, aic double")


@query("elimination_path")
def elimination_path(t: Tables) -> DataFrame:
    lines = dated_lines(t).withColumn("gross", F.col("l_quantity") * (1 + F.col("l_tax")))
    fit, path = models.eliminate(lines, "l_extendedprice", [*STEP_TERMS, "gross"])
    rows = [(p["step"], p["term"], p["reason"], p["p_value"]) for p in path]
    rows.append((len(path) + 1, ", ".join(fit.names), "kept", max(fit.p_values[:-1])))
    return t.spark.createDataFrame(rows, "step int, term string, reason string, p_value double")


def predicted() -> Column:
    return 900 + 1450 * F.col("l_quantity") - 2000 * F.col("l_discount")


SQL_PREDICTED = "(900 + 1450 * l_quantity - 2000 * l_discount)"


@query("r2_by_correlation", f"SELECT round(corr(l_extendedprice, {SQL_PREDICTED}) ** 2, 6) AS r2 FROM lineitem")
def r2_by_correlation(t: Tables) -> DataFrame:
    return evaluate.r2_corr(t.lineitem.withColumn("yhat", predicted()), "l_extendedprice", "yhat")


@query("residual_summary", f"""
SELECT l_returnflag, count(*)::BIGINT AS n_rows, round(avg(l_extendedprice - {SQL_PREDICTED}), 3) AS mean_residual,
round(stddev_samp(l_extendedprice - {SQL_PREDICTED}), 3) AS sd_residual,
round(max(abs(l_extendedprice - {SQL_PREDICTED})), 3) AS max_abs FROM lineitem GROUP BY 1""")
def residual_summary(t: Tables) -> DataFrame:
    table = evaluate.residuals(t.lineitem.withColumn("yhat", predicted()), "l_extendedprice", "yhat")
    return table.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("residual"), 3).alias("mean_residual"),
        F.round(F.stddev_samp("residual"), 3).alias("sd_residual"), F.round(F.max(F.abs("residual")), 3).alias("max_abs"))


@query("r2_gap", f"""
WITH p AS (SELECT o_totalprice AS y, 100000 + 3 * o_custkey + 5000 * month(o_orderdate) AS yhat,
left(md5(o_orderkey::VARCHAR || ':5'), 8) < '{sampling.share_of_hashes(0.7)}' AS train FROM orders),
r AS (SELECT corr(y, yhat) FILTER (WHERE train) ** 2 AS a, corr(y, yhat) FILTER (WHERE NOT train) ** 2 AS b FROM p)
SELECT round(a, 6) AS r2_train, round(b, 6) AS r2_test, round(a - b, 6) AS gap, abs(a - b) <= 0.05 AS within_limit FROM r""")
def r2_gap(t: Tables) -> DataFrame:
    yhat = 100000 + 3 * F.col("o_custkey") + 5000 * F.month("o_orderdate")
    parts = sampling.split(t.orders.withColumn("yhat", yhat), "o_orderkey", 0.7, 5)
    return evaluate.r2_gap(parts, "o_totalprice", "yhat", F.col("part") == "train")


@query("category_price_fit", """
SELECT CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN '(intercept)' ELSE 'p_type_' || p_type END AS term,
round(avg(p_retailprice) - CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN 0 ELSE
(SELECT avg(p_retailprice) FROM part WHERE p_type = (SELECT min(p_type) FROM part)) END, 4) AS estimate FROM part GROUP BY p_type""")
def category_price_fit(t: Tables) -> DataFrame:
    coded = prep.dummies(t.part.select("p_retailprice", "p_type"), ["p_type"])
    fit = models.fit_ols(coded, "p_retailprice", [c for c in coded.columns if c != "p_retailprice"])
    return fit.table(coded, 4).select("term", "estimate")


SQL_AIC = """m AS (SELECT count(*)::DOUBLE AS n, covar_pop(l_extendedprice, l_extendedprice) AS syy, covar_pop(l_quantity, l_quantity) AS s11,
covar_pop(l_tax, l_tax) AS s22, covar_pop(l_quantity, l_tax) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1y,
covar_pop(l_tax, l_extendedprice) AS s2y FROM lineitem),
a AS (SELECT n * ln(syy) + 2 AS a0, n * ln(syy - s1y * s1y / s11) + 4 AS a1, n * ln(syy - s2y * s2y / s22) + 4 AS a2,
n * ln(syy - (s22 * s1y * s1y - 2 * s12 * s1y * s2y + s11 * s2y * s2y) / (s11 * s22 - s12 * s12)) + 6 AS a12 FROM m)"""


@query("step_aic_two_terms", f"""
WITH {SQL_AIC} SELECT 0 AS step, 'start' AS action, '' AS term, round(a12, 3) AS aic FROM a
UNION ALL SELECT 1, 'drop', CASE WHEN a1 < a2 THEN 'l_tax' ELSE 'l_quantity' END, round(least(a1, a2), 3) FROM a WHERE least(a1, a2) < a12
UNION ALL SELECT 2, 'drop', CASE WHEN a1 < a2 THEN 'l_quantity' ELSE 'l_tax' END, round(a0, 3) FROM a
WHERE least(a1, a2) < a12 AND a0 < least(a1, a2)""")
def step_aic_two_terms(t: Tables) -> DataFrame:
    path = models.step_aic(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"])
    rows = [(p["step"], p["action"], p["term"], round(p["aic"], 3)) for p in path]
    return t.spark.createDataFrame(rows, "step int, action string, term string, aic double")
