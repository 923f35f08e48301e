"""Evaluation of scores and classes, score cards and their financial effect."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.ranking import ROWS_PER_RANGE, running_totals, tiles
from tallyforge.session import materialise


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _share(part: Column, whole: Column, digits: int | None) -> Column:
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return share if digits is None else F.round(share, digits)


def confusion(df: DataFrame, label: str, pred: str, positive: object, digits: int = 6) -> DataFrame:
    """Confusion cells, accuracy, sensitivity and specificity for a named positive class, in one aggregate."""
    actual, said = F.col(label) == F.lit(positive), F.col(pred) == F.lit(positive)
    cells = df.agg(_n(actual & said).alias("tp"), _n(~actual & said).alias("fp"),
                   _n(actual & ~said).alias("fn"), _n(~actual & ~said).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns({
        "accuracy": _share(tp + tn, tp + fp + fn + tn, digits),
        "sensitivity": _share(tp, tp + fn, digits),
        "specificity": _share(tn, tn + fp, digits),
    })


def confusion_multi(df: DataFrame, label: str, pred: str, digits: int = 6) -> DataFrame:
    """Sensitivity and specificity of every class against all others."""
    cells = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.col("n"), F.inline(F.array(
        F.struct(F.col(label).cast("string").alias("class"), F.lit(1).alias("is_actual"),
                 (F.col(label) == F.col(pred)).cast("int").alias("is_hit")),
        F.struct(F.col(pred).cast("string").alias("class"), F.lit(0).alias("is_actual"), F.lit(0).alias("is_hit")))))
    per_class = both.groupBy("class").agg(
        F.sum(F.col("n") * F.col("is_actual")).alias("n_actual"),
        F.sum(F.col("n") * (1 - F.col("is_actual"))).alias("n_predicted"),
        F.sum(F.col("n") * F.col("is_hit")).alias("tp"))
    total = cells.agg(F.sum("n").alias("n")).scalar()
    others = total - F.col("n_actual")
    return per_class.withColumns({
        "sensitivity": _share(F.col("tp"), F.col("n_actual"), digits),
        "specificity": _share(others - (F.col("n_predicted") - F.col("tp")), others, digits),
    })


def threshold_sweep(df: DataFrame, label: str, score: str, cutoffs: Sequence[float], digits: int = 6) -> DataFrame:
    """Sensitivity, specificity and accuracy of ``score >= cutoff`` for every cut-off, from one aggregate.

    Each row is counted once, in the slot between two cut-offs; the sweep is a running sum over those slots.
    """
    cutoffs = sorted(cutoffs)
    cutter = Bucketizer(splits=[float("-inf"), *cutoffs, float("inf")], inputCol="_score", outputCol="_slot")
    scored = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("_score"),
                                                       F.col(label).cast("int").alias("_label"))
    slots = cutter.transform(scored).groupBy(F.col("_slot").cast("int").alias("_slot")).agg(
        F.sum("_label").alias("_pos"), F.sum(1 - F.col("_label")).alias("_neg"))
    grid = df.sparkSession.createDataFrame(
        [(0, None)] + [(i + 1, float(c)) for i, c in enumerate(cutoffs)], "_slot int, cutoff double")
    # as many rows as there are cut-offs from here on
    filled = grid.join(slots, "_slot", "left").fillna(0, ["_pos", "_neg"])
    above = W.orderBy(F.col("_slot").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy()
    summed = filled.select(
        "cutoff", F.sum("_pos").over(above).alias("tp"), F.sum("_neg").over(above).alias("fp"),
        F.sum("_pos").over(everything).alias("pos"), F.sum("_neg").over(everything).alias("neg"))
    return summed.where("cutoff IS NOT NULL").select(
        "cutoff", _share(F.col("tp"), F.col("pos"), digits).alias("sensitivity"),
        _share(F.col("neg") - F.col("fp"), F.col("neg"), digits).alias("specificity"),
        _share(F.col("tp") + F.col("neg") - F.col("fp"), F.col("pos") + F.col("neg"), digits).alias("accuracy"))


def best_cutoff(sweep: DataFrame) -> DataFrame:
    """The cut-off at which sensitivity and specificity are closest; the smaller one wins a tie."""
    gap = F.abs(F.col("sensitivity") - F.col("specificity"))
    return sweep.orderBy(F.round(gap, 9), "cutoff").limit(1)


def _score_curve(df: DataFrame, label: str, score: str, rows_per_range: int) -> DataFrame:
    event = F.col(label).cast("bigint")
    return running_totals(df, score, {"pos": event, "neg": 1 - event}, descending=True, rows_per_range=rows_per_range)


def ks(df: DataFrame, label: str, score: str, digits: int = 6, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Largest distance between the cumulative shares of events and non-events over all scores."""
    curve = materialise(_score_curve(df, label, score, rows_per_range), "score-curve")
    whole = curve.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    distance = F.try_divide(F.col("cum_pos").cast("double"), F.lit(whole["p"])) - F.try_divide(
        F.col("cum_neg").cast("double"), F.lit(whole["n"]))
    return curve.select(distance.alias("_distance")).agg(F.round(F.max("_distance"), digits).alias("ks"))


def auc(df: DataFrame, label: str, score: str, digits: int = 6, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Area under the ROC curve: the chance that an event outscores a non-event, ties counting half."""
    curve = _score_curve(df, label, score, rows_per_range)
    below = F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") / 2.0)
    sums = curve.agg(F.sum(below).alias("worse"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    whole = F.col("p").cast("double") * F.col("n")
    return sums.select(F.round(1 - F.try_divide(F.col("worse"), whole), digits).alias("auc"))


def roc_points(df: DataFrame, label: str, score: str, cutoffs: Sequence[float], digits: int = 6) -> DataFrame:
    """Points of the ROC curve at given cut-offs: false and true positive rate."""
    sweep = threshold_sweep(df, label, score, cutoffs, digits)
    return sweep.select("cutoff", F.round(1 - F.col("specificity"), digits).alias("fpr"), F.col("sensitivity").alias("tpr"))


def on_class(score: str, cutoff: float) -> Column:
    """Hard 0/1 decision, for KS and AUC of classes instead of scores."""
    return F.when(F.col(score) >= cutoff, 1.0).otherwise(0.0)


def gain_lift(df: DataFrame, label: str, score: str, key: str, n: int = 10, digits: int = 4,
              rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """What the best-scored tiles catch: for all rows up to a tile, the share of all events among them (``captured``), and
    their event rate over that of the whole table (``lift``)."""
    tiled = tiles(materialise(df.select(key, label, score), "scored"), score, key, n, True, "tile", rows_per_range)
    counts = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("rows_in"), F.sum(F.col(label).cast("bigint")).alias("events_in"))
    # n rows from here on
    best, whole = W.orderBy("tile").rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy()
    seen = counts.select(
        "tile", "rows_in", "events_in", F.sum("events_in").over(best).alias("events_upto"), F.sum("rows_in").over(best).alias("rows_upto"),
        F.sum("events_in").over(whole).alias("events"), F.sum("rows_in").over(whole).alias("rows"))
    rate_upto, rate = F.col("events_upto") / F.col("rows_upto"), F.col("events") / F.col("rows")
    return seen.select("tile", "rows_in", "events_in", _share(F.col("events_upto"), F.col("events"), digits).alias("captured"),
                       F.round(F.try_divide(rate_upto, rate), digits).alias("lift"))


def r2_corr(df: DataFrame, actual: str, predicted: str, digits: int = 6) -> DataFrame:
    """Squared correlation of actual and predicted values."""
    r = F.corr(actual, predicted)
    return df.agg(F.round(r * r, digits).alias("r2"))


def r2_gap(rows: DataFrame, actual: str, predicted: str, is_train: Column, limit: float = 0.05, digits: int = 6) -> DataFrame:
    """Fit on training and on all other rows, their difference, and whether that is within ``limit``; one aggregate."""
    def fit(which: Column) -> Column:
        r = F.corr(F.when(which, F.col(actual)), F.when(which, F.col(predicted)))
        return F.round(r * r, 12)

    both = rows.agg(fit(is_train).alias("r2_train"), fit(~is_train).alias("r2_test"))
    difference = F.col("r2_train") - F.col("r2_test")
    return both.select(F.round("r2_train", digits).alias("r2_train"), F.round("r2_test", digits).alias("r2_test"),
                       F.round(difference, digits).alias("gap"), (F.abs(difference) <= limit).alias("within_limit"))


def residuals(df: DataFrame, actual: str, predicted: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, F.col(actual) - F.col(predicted))


def compare_models(metrics: Mapping[str, DataFrame]) -> DataFrame:
    """Stack one-row metric tables under their model names."""
    result = None
    for name, table in metrics.items():
        named = table.withColumn("model", F.lit(name))
        result = named if result is None else result.unionByName(named, allowMissingColumns=True)
    return result


# 20 points to double the odds, 400 at odds of 10; cost 5, loss 1500 and revenue 100 per row.


def score_points(p_bad: Column | str, pdo: float = 20, base: float = 400, odds: float = 10) -> Column:
    """Points that rise by ``pdo`` whenever the odds of a good outcome double; ``base`` points at ``odds``."""
    p_bad = F.col(p_bad) if isinstance(p_bad, str) else p_bad
    factor = pdo / math.log(2)
    return F.lit(base - factor * math.log(odds)) + F.lit(factor) * F.ln((1 - p_bad) / p_bad)


def points_at(p_bad: float, pdo: float = 20, base: float = 400, odds: float = 10) -> float:
    factor = pdo / math.log(2)
    return base - factor * math.log(odds) + factor * math.log((1 - p_bad) / p_bad)


def scorecard(df: DataFrame, p_bad: str, pdo: float = 20, base: float = 400, odds: float = 10,
              out: str = "score") -> DataFrame:
    return df.withColumn(out, score_points(p_bad, pdo, base, odds))


def decide(df: DataFrame, cutoff: float, score: str = "score", out: str = "decision") -> DataFrame:
    """Accept above the cut-off score, reject at or below it."""
    return df.withColumn(out, F.when(F.col(score) > cutoff, "accept").otherwise("reject"))


def profit_impact(df: DataFrame, bad: Column, accepted: Column, cost: float = 5, loss: float = 1500,
                  revenue: float = 100, digits: int = 4) -> DataFrame:
    """Yearly profit when everyone is accepted and when only accepted rows are, from one aggregate."""
    cells = df.agg(F.count(F.lit(1)).alias("n_all"), _n(bad).alias("bad_all"), _n(accepted).alias("n_accepted"),
                   _n(accepted & bad).alias("bad_accepted"))

    def profit(rows: str, bads: str) -> Column:
        return revenue * (F.col(rows) - F.col(bads)) - cost * F.col(rows) - loss * F.col(bads)

    table = cells.withColumns({"profit_without": profit("n_all", "bad_all").cast("double"),
                               "profit_with": profit("n_accepted", "bad_accepted").cast("double")})
    gain = F.try_divide(F.col("profit_with") - F.col("profit_without"), F.abs(F.col("profit_without")))
    return table.withColumns({"loss_avoided": (loss * (F.col("bad_all") - F.col("bad_accepted"))).cast("double"),
                              "gain_pct": F.round(100 * gain, digits)})
