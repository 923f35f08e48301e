"""Selection of variables, trees and models on outcomes planted by a hash, so that what a fit must find is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import bands
from tallyforge.operators import evaluate, machines, models, prep, ranking, sampling, trees, woe
from tallyforge.plans import credit
from tallyforge.plans.registry import Tables, query
from tallyforge.session import materialise

#: Chance of the outcome for orders that are not urgent, urgent and dear, urgent and cheap.
PLAIN, DEAR, CHEAP = 0.1, 0.9, 0.45
PREDICTORS = ["urgent", "dear", "total", "noise"]
CUTOFFS = [i / 100 for i in range(1, 100)]


def _hash_sql(seed: int) -> str:
    return f"left(md5(o_orderkey::VARCHAR || ':{seed}'), 8)"


SQL_PLANTED = f"""planted AS (SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS urgent, (o_totalprice > 150000)::INT AS dear,
({_hash_sql(21)} < CASE WHEN o_orderpriority <> '1-URGENT' THEN '{sampling.share_of_hashes(PLAIN)}'
  WHEN o_totalprice > 150000 THEN '{sampling.share_of_hashes(DEAR)}' ELSE '{sampling.share_of_hashes(CHEAP)}' END)::INT AS label FROM orders)"""
#: A root split on ``urgent`` and one on ``dear`` below each side; l, r and m are what the splits save in errors.
SQL_STAGES = f"""{SQL_PLANTED}, cells AS (SELECT urgent, dear, count(*) AS n, sum(label) AS e FROM planted GROUP BY ALL),
sides AS (SELECT urgent, least(sum(e), sum(n - e)) AS wrong, sum(least(e, n - e)) AS below FROM cells GROUP BY urgent),
gains AS (SELECT (SELECT least(sum(e), sum(n - e)) FROM cells) AS root, (SELECT sum(wrong) FROM sides) AS split,
(SELECT wrong - below FROM sides WHERE urgent = 0) AS l, (SELECT wrong - below FROM sides WHERE urgent = 1) AS r, (SELECT sum(n) FROM cells) AS total),
stages AS (SELECT 0 AS step, 0::DOUBLE AS alpha, l > 0 AS has_l, r > 0 AS has_r, root > split - l - r AS has_root FROM gains
UNION ALL SELECT step + 1, cost, has_l AND l > cost * total + 1e-9, has_r AND r > cost * total + 1e-9, top > cost * total + 1e-9
FROM (SELECT *, least(CASE WHEN has_l THEN l ELSE 1e18 END, CASE WHEN has_r THEN r ELSE 1e18 END, top) / total::DOUBLE AS cost
  FROM (SELECT *, (root - split + CASE WHEN has_l THEN l ELSE 0 END + CASE WHEN has_r THEN r ELSE 0 END)::DOUBLE
    / (1 + has_l::INT + has_r::INT) AS top FROM stages, gains WHERE has_root))),
sequence AS (SELECT step, round(alpha, 8) AS alpha, CASE WHEN has_root THEN 2 + has_l::INT + has_r::INT ELSE 1 END::INT AS n_leaves,
(CASE WHEN has_root THEN split - CASE WHEN has_l THEN l ELSE 0 END - CASE WHEN has_r THEN r ELSE 0 END ELSE root END)::BIGINT AS n_errors
FROM stages, gains)"""


def planted(t: Tables) -> DataFrame:
    urgent, dear = F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 150000
    drawn = sampling.key_hash("o_orderkey", 21)
    rate = F.when(~urgent, sampling.share_of_hashes(PLAIN)).when(dear, sampling.share_of_hashes(DEAR)).otherwise(sampling.share_of_hashes(CHEAP))
    rows = t.orders.select("o_orderkey", urgent.cast("int").alias("urgent"), dear.cast("int").alias("dear"),
                           F.col("o_totalprice").cast("double").alias("total"), (F.col("o_custkey") % 97).cast("double").alias("noise"),
                           (drawn < rate).cast("int").alias("label"))
    return materialise(rows, "planted")


def folds(seed: int = 0) -> Column:
    return machines.fold_of(F.col("o_orderkey"), 5, seed)


@query("pruning_sequence", f"WITH RECURSIVE {SQL_STAGES} SELECT * FROM sequence")
def pruning_sequence(t: Tables) -> DataFrame:
    """Which subtrees a growing cost per leaf leaves of a tree with two levels, and what errors they make."""
    rows = planted(t)
    tree = trees.grow(rows, "label", ["urgent", "dear"], min_leaf=1, max_depth=2)
    counts = trees.class_counts(rows, "label", [tree], F.lit(0))[0, 0]
    found = [(i, round(s.alpha, 8), s.leaves, s.errors) for i, s in enumerate(trees.pruning_sequence(tree, counts))]
    return t.spark.createDataFrame(found, "step int, alpha double, n_leaves int, n_errors bigint")


@query("tree_cv_table", f"""
WITH RECURSIVE {SQL_STAGES}, last AS (SELECT max(step) AS last FROM sequence)
SELECT step, n_leaves, (SELECT count(*) FROM orders)::BIGINT AS n_rows, step < last AS better_than_root FROM sequence, last""")
def tree_cv_table(t: Tables) -> DataFrame:
    """The same sequence under cross-validation: every stage is held against all rows, each by a tree that has not seen it."""
    found = trees.fit_pruned(planted(t), "label", ["urgent", "dear"], folds(), min_leaf=1, max_depth=2)
    rows = [(i, s.leaves, found.rows, found.errors[i] < found.errors[-1]) for i, s in enumerate(found.stages)]
    return t.spark.createDataFrame(rows, "step int, n_leaves int, n_rows bigint, better_than_root boolean")


def train_test(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows, each predictor also as the weight of its bin among the training rows, written."""
    parts = sampling.split(planted(t), "o_orderkey", 0.7, 23)
    known = parts.where("part = 'train'")
    bins = woe.bin_columns(known, ["total", "noise"], ["urgent", "dear"], bins=5)
    table = woe.woe_table(known, bins, F.col("label"))
    both = materialise(woe.woe_transform(parts, table, bins), "weighed")
    return both.where("part = 'train'"), both.where("part = 'test'")


SQL_TEST = f"orders WHERE {_hash_sql(23)} >= '{sampling.share_of_hashes(0.7)}'"


def learned(name: str, scored: DataFrame) -> DataFrame:
    """One row: whether a score of held-out rows ranks well, and does so on both sides of its own best cut-off."""
    rows = materialise(scored.select("label", "p"), f"scored-{name.replace(' ', '-')}")
    best = evaluate.best_cutoff(evaluate.threshold_sweep(rows, "label", "p", CUTOFFS))
    good = (F.col("sensitivity") >= 0.5) & (F.col("specificity") >= 0.5)
    return best.select(F.lit(name).alias("model"), F.lit(rows.count()).cast("bigint").alias("n_rows"),
                       (F.lit(evaluate.auc(rows, "label", "p").scalar()) >= 0.65).alias("ranks"), good.alias("decides"))


@query("tree_metrics", f"SELECT 'tree' AS model, count(*)::BIGINT AS n_rows, true AS ranks, true AS decides FROM {SQL_TEST}")
def tree_metrics(t: Tables) -> DataFrame:
    """A tree of all predictors, pruned by cross-validation, on held-out rows."""
    train, test = train_test(t)
    tree = trees.fit_pruned(train, "label", PREDICTORS, folds())
    return learned("tree", test.withColumn("p", tree.probability()))


@query("forest_importance", """
SELECT unnest(['urgent', 'dear', 'total', 'noise']) AS term, unnest([true, true, true, false]) AS matters, n_rows
FROM (SELECT count(*)::BIGINT AS n_rows FROM orders)""")
def forest_importance(t: Tables) -> DataFrame:
    """Which predictors a forest uses: price counts as itself and as a flag, the customer's number is no help."""
    rows = planted(t)
    weights = models.importances(models.fit_forest(rows, "label", PREDICTORS, trees=50, per_split=2, max_depth=2), PREDICTORS, rows)
    return weights.select("term", (F.col("importance") >= 0.02).alias("matters"), F.lit(rows.count()).cast("bigint").alias("n_rows"))


@query("model_comparison", f"""
SELECT unnest(['logit', 'logit of weights', 'tree', 'tree of weights', 'forest']) AS model, n_rows, true AS ranks, true AS decides
FROM (SELECT count(*)::BIGINT AS n_rows FROM {SQL_TEST})""")
def model_comparison(t: Tables) -> DataFrame:
    """Five models on plain predictors and on weights of evidence, each judged at its own best cut-off on held-out rows."""
    train, test = train_test(t)
    weights = [f"{x}_woe" for x in PREDICTORS]
    scores = {
        "logit": models.linear_score(models.fit_logit(train, "label", PREDICTORS)),
        "logit of weights": models.linear_score(models.fit_logit(train, "label", weights)),
        "tree": trees.fit_pruned(train, "label", PREDICTORS, folds()).probability(),
        "tree of weights": trees.fit_pruned(train, "label", weights, folds()).probability(),
    }
    tables = {name: learned(name, test.withColumn("p", p)).drop("model") for name, p in scores.items()}
    forest = models.fit_forest(train, "label", PREDICTORS, trees=50, per_split=2)
    tables["forest"] = learned("forest", models.score(forest, test)).drop("model")
    return evaluate.compare_models(tables).select("model", "n_rows", "ranks", "decides")


# --- variables: the levels of one category, two of which behave alike ------------------------------------------------

#: Chance of the outcome, and what is added to the price, by priority.
RATES = {"1-URGENT": 0.5, "2-HIGH": 0.5, "3-MEDIUM": 0.3, "4-NOT SPECIFIED": 0.3, "5-LOW": 0.1}
SHIFTS = {"1-URGENT": 0, "2-HIGH": 0, "3-MEDIUM": 60_000, "4-NOT SPECIFIED": 60_000, "5-LOW": 120_000}
VIF_MAX = 1.5


def _by_code_sql(values: dict[str, object]) -> str:
    return "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


def _subsets_sql(outcome: str) -> str:
    """Counts and sums per level and, for every subset of the levels beside the first, of all levels outside it taken as one."""
    return f"""rows AS (SELECT o_orderpriority AS code, ({outcome})::DOUBLE AS y FROM orders),
levels AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS j, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS ss FROM rows GROUP BY code),
whole AS (SELECT sum(n) AS total, max(j) AS k FROM levels),
subsets AS (SELECT unnest(range((1 << (SELECT k FROM whole))::BIGINT)) AS m),
cells AS (SELECT m, CASE WHEN j > 0 AND (m >> (j - 1)::BIGINT) & 1 = 1 THEN j ELSE 0 END AS j, sum(n) AS n, sum(s) AS s, sum(ss) AS ss
  FROM subsets, levels GROUP BY ALL)"""


def _path_sql(criterion: str) -> str:
    """The best single change of each subset, followed from the full one."""
    return f"""values_of AS (SELECT m, {criterion} + 2 * count(*) AS aic FROM cells, whole GROUP BY m, total),
moves AS (SELECT a.m, code, b.m AS next, a.aic AS before, b.aic FROM values_of a, levels, values_of b
  WHERE j > 0 AND b.m = xor(a.m, 1 << (j - 1)::BIGINT)),
best AS (SELECT * FROM moves QUALIFY row_number() OVER (PARTITION BY m ORDER BY aic, code) = 1),
path AS (SELECT 0 AS step, 'start' AS action, '' AS term, aic, m FROM values_of WHERE m = (SELECT max(m) FROM subsets)
  UNION ALL SELECT step + 1, CASE WHEN next < path.m THEN 'drop' ELSE 'add' END, 'code_' || code, best.aic, next
  FROM path JOIN best ON best.m = path.m WHERE best.aic < best.before - 1e-9)
SELECT step, action, term, round(aic, 4) AS aic FROM path"""


def _elimination_sql(statistic: str, limit: str) -> str:
    """Levels against all outside the subset: inflation and test statistic of each, and which one goes."""
    return f"""tests AS (SELECT x.m, code, (total - x.n) * (z.n + x.n) / (total * z.n) AS vif, {statistic} AS stat, {limit} AS least,
  count(*) OVER (PARTITION BY x.m) AS held, x.m - (1 << (x.j - 1)::BIGINT) AS next
  FROM cells x JOIN cells z ON z.m = x.m AND z.j = 0 JOIN levels ON levels.j = x.j JOIN fits ON fits.m = x.m, whole WHERE x.j > 0),
kinds AS (SELECT *, vif > {VIF_MAX} AS inflated, stat < least AS weak FROM tests WHERE held > 1),
going AS (SELECT *, CASE WHEN inflated AND weak THEN 'vif and p' WHEN weak THEN 'p' ELSE 'vif' END AS reason FROM kinds WHERE inflated OR weak
  QUALIFY row_number() OVER (PARTITION BY m ORDER BY (inflated AND weak) DESC, weak DESC, CASE WHEN inflated AND weak THEN -vif WHEN weak THEN stat ELSE -vif END, code) = 1),
path AS (SELECT 1 AS step, code, reason, vif, inflated, next FROM going WHERE m = (SELECT max(m) FROM subsets)
  UNION ALL SELECT step + 1, going.code, going.reason, going.vif, going.inflated, going.next FROM path JOIN going ON going.m = path.next)
SELECT step::INT AS step, 'code_' || code AS term, reason, round(CASE WHEN inflated THEN vif END, 6) AS vif FROM path"""


_EVENT = "CASE WHEN s > 0 AND s < n THEN s * ln(s / n) + (n - s) * ln(1 - s / n) ELSE 0 END"
SQL_OUTCOME = f"{_hash_sql(31)} < {_by_code_sql({k: sampling.share_of_hashes(v) for k, v in RATES.items()})}"
SQL_PRICE = f"o_totalprice + {_by_code_sql(SHIFTS)}"


def coded(t: Tables) -> tuple[DataFrame, list[str]]:
    """Orders with an outcome and a price that depend on the priority, and its levels as 0/1 columns."""
    code = F.col("o_orderpriority")
    chance = F.create_map(*[x for k, v in RATES.items() for x in (F.lit(k), F.lit(sampling.share_of_hashes(v)))])
    shift = F.create_map(*[x for k, v in SHIFTS.items() for x in (F.lit(k), F.lit(float(v)))])
    rows = t.orders.select(code.alias("code"), (sampling.key_hash("o_orderkey", 31) < chance[code]).cast("int").alias("outcome"),
                           (F.col("o_totalprice") + shift[code]).alias("price"))
    table = materialise(prep.dummies(rows, ["code"]), "coded")
    return table, [c for c in table.columns if c.startswith("code_")]


def path_table(t: Tables, path: list[dict]) -> DataFrame:
    return t.spark.createDataFrame([(p["step"], p["action"], p["term"], round(p["aic"], 4)) for p in path],
                                   "step int, action string, term string, aic double")


def elimination_table(t: Tables, path: list[dict]) -> DataFrame:
    rows = [(p["step"], p["term"], p["reason"], None if p["vif"] is None else round(p["vif"], 6)) for p in path]
    return t.spark.createDataFrame(rows, "step int, term string, reason string, vif double")


@query("step_aic_levels", f"""WITH RECURSIVE {_subsets_sql(SQL_PRICE)}, {_path_sql("total * ln(sum(ss - s * s / n) / total)")}""")
def step_aic_levels(t: Tables) -> DataFrame:
    table, xs = coded(t)
    return path_table(t, models.step_aic(table, "price", xs))


@query("logit_step_levels", f"""WITH RECURSIVE {_subsets_sql(SQL_OUTCOME)}, {_path_sql(f"-2 * sum({_EVENT})")}""")
def logit_step_levels(t: Tables) -> DataFrame:
    """Stepwise logistic selection among levels; every candidate model is a table of rates, so SQL knows its likelihood."""
    table, xs = coded(t)
    return path_table(t, models.step_aic(table, "outcome", xs, "logit"))


@query("elimination_levels", f"""WITH RECURSIVE {_subsets_sql(SQL_PRICE)},
fits AS (SELECT m, sum(ss - s * s / n) / (total - count(*)) AS variance, total - count(*) AS freedom FROM cells, whole GROUP BY m, total),
{_elimination_sql("abs(x.s / x.n - z.s / z.n) / sqrt(variance * (1 / x.n + 1 / z.n))", "1.959963984540054 + 2.372271 / freedom + 2.8225 / freedom ** 2")}""")
def elimination_levels(t: Tables) -> DataFrame:
    table, xs = coded(t)
    return elimination_table(t, models.eliminate(table, "price", xs, vif_max=VIF_MAX)[1])


@query("logit_elimination_levels", f"""WITH RECURSIVE {_subsets_sql(SQL_OUTCOME)}, fits AS (SELECT m FROM subsets),
{_elimination_sql("abs(ln(x.s / (x.n - x.s)) - ln(z.s / (z.n - z.s))) / sqrt(1 / x.s + 1 / (x.n - x.s) + 1 / z.s + 1 / (z.n - z.s))",
                  "1.959963984540054")}""")
def logit_elimination_levels(t: Tables) -> DataFrame:
    table, xs = coded(t)
    return elimination_table(t, models.eliminate(table, "outcome", xs, "logit", vif_max=VIF_MAX)[1])


# --- order by a fitted score, and helpers that had no query ----------------------------------------------------------


@query("ranked_predictions", f"""
WITH {credit.SQL_FITTED} SELECT o_orderkey, row_number() OVER (ORDER BY p DESC, o_orderkey)::BIGINT AS position
FROM known JOIN rates USING (code) WHERE NOT train""")
def ranked_predictions(t: Tables) -> DataFrame:
    """Held-out rows in the order of their fitted chance of the bad outcome, cut into ranges, not sorted in one task."""
    _, held, _ = credit.fitted_on_known(t)
    return ranking.row_positions(held.select("o_orderkey", F.round("p", 9).alias("p")), "p", "o_orderkey").select("o_orderkey", "position")


@query("roc_curve", f"""
WITH {credit.SQL_SWEEP} SELECT cutoff, round(1 - specificity, 6) AS fpr, sensitivity AS tpr FROM sweep""")
def roc_curve(t: Tables) -> DataFrame:
    return evaluate.roc_points(credit.scored(t), "bad", "p_bad", CUTOFFS)


@query("dummy_cells", """
SELECT dummy, count(*)::BIGINT AS n_rows FROM (SELECT 'o_orderpriority_' || o_orderpriority AS dummy FROM orders
UNION ALL SELECT 'o_custkey_' || o_custkey FROM orders) GROUP BY dummy""")
def dummy_cells(t: Tables) -> DataFrame:
    """The ones of a dummy coding of any number of levels, counted."""
    cells = prep.dummies_long(t.orders, "o_orderkey", ["o_orderpriority", "o_custkey"])
    return cells.groupBy("dummy").agg(F.count(F.lit(1)).alias("n_rows"))


@query("own_level_counts", """
SELECT coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'NA') AS level, count(*)::BIGINT AS n_rows FROM customer GROUP BY 1""")
def own_level_counts(t: Tables) -> DataFrame:
    level = bands.own_level(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return t.customer.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n_rows"))
