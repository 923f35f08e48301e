"""Weight of evidence and information value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bands import cut, cut_labels
from tallyforge.operators.ranking import quantiles_of
from tallyforge.session import materialise


def bin_columns(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), bins: int = 10,
                numbered: bool = False) -> dict[str, Column]:
    """Bin label expression per variable: equal-frequency bins for numbers, own values for categories.

    Bins are named by their interval, or 1, 2, .. with ``numbered``. The outer bins are open, so later rows beyond
    the range seen here fall into them. Nulls get the level ``NA``.
    """
    found: dict[str, Column] = {}
    cuts = quantiles_of(df, numeric, [i / bins for i in range(bins + 1)]) if numeric else {}
    for c in numeric:
        edges = sorted({e for e in cuts[c] if e is not None})
        if len(edges) < 2:
            found[c] = F.when(F.col(c).isNull(), "NA").otherwise("1" if numbered else "all")
            continue
        open_edges = [float("-inf"), *edges[1:-1], float("inf")]
        labels = [str(i + 1) for i in range(len(edges) - 1)] if numbered else cut_labels(edges, include_lowest=True)
        found[c] = F.coalesce(cut(c, open_edges, labels), F.lit("NA"))
    for c in categorical:
        found[c] = F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("NA"))
    return found


def woe_table(df: DataFrame, bins: dict[str, Column], target: Column, adjust: float = 0.5, digits: int = 6) -> DataFrame:
    """One row per variable and bin: counts, shares of events and non-events, weight of evidence, value.

    All variables share one aggregate. Rows are first counted per combination of bins on the map side,
    so what is shuffled are bin counts. ``adjust`` stands in for a class that a bin lacks, where the logarithm has no value.
    """
    event = target.cast("int")
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), b.alias("bin")) for v, b in bins.items()])
    long = df.select(event.alias("_event"), F.inline(pairs))
    counts = long.groupBy("variable", "bin").agg(
        F.count("_event").alias("n_rows"), F.sum("_event").cast("bigint").alias("n_events"))
    # the class totals are two numbers from a pass over the target alone
    events, rows = df.agg(F.coalesce(F.sum(event), F.lit(0)), F.count(event)).first()
    good = F.col("n_rows") - F.col("n_events")
    lacking = (good == 0) | (F.col("n_events") == 0)
    bump = F.when(lacking, F.lit(adjust)).otherwise(F.lit(0.0))
    shares = counts.withColumns({
        "pct_events": F.try_divide(F.col("n_events") + bump, F.lit(float(events))),
        "pct_others": F.try_divide(good + bump, F.lit(float(rows - events))),
    })
    woe = F.ln(F.col("pct_events") / F.col("pct_others"))
    return shares.select(
        "variable", "bin", "n_rows", "n_events", F.round("pct_events", digits).alias("pct_events"),
        F.round("pct_others", digits).alias("pct_others"), F.round(woe, digits).alias("woe"),
        F.round((F.col("pct_events") - F.col("pct_others")) * woe, digits).alias("iv"))


def iv_ranking(table: DataFrame, low: float = 0.1, high: float = 0.5, digits: int = 5) -> DataFrame:
    """Information value per variable, and whether it is in the useful range."""
    ranked = table.groupBy("variable").agg(F.round(F.sum("iv"), digits).alias("iv"))
    return ranked.withColumn("selected", F.col("iv").between(low, high))


def woe_transform(df: DataFrame, table: DataFrame, bins: dict[str, Column]) -> DataFrame:
    """Add ``<variable>_woe``, the weight of each row's bin, for every variable.

    Weights are joined one variable after the other; a variable may have any number of bins. Spark broadcasts tables below its
    threshold, so with ordinary bins no row moves.
    """
    table = materialise(table.select("variable", "bin", "woe"), "woe-table")
    for i, (v, b) in enumerate(bins.items()):
        weights = table.where(F.col("variable") == v).select(F.col("bin").alias(f"_bin_{i}"), F.col("woe").alias(f"{v}_woe"))
        df = df.withColumn(f"_bin_{i}", b).join(weights, f"_bin_{i}", "left").drop(f"_bin_{i}")
    return df
