"""Data preparation: limiting, imputation, encoding, scaling, binning.

Operators that need numbers from the data (percentiles, levels, means) read them in one aggregate first and put them
into the plan as literals, so the rows themselves are only mapped and never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bands import clamp as clamp_value
from tallyforge.functions.bands import cut, cut_labels
from tallyforge.operators.aggregates import mode_of
from tallyforge.operators.joins import null_safe_join
from tallyforge.operators.ranking import quantile_table, quantiles

MAX_LEVELS = 10_000  # 0/1 columns that a table can sensibly have; ``dummies_long`` has no limit


def clamp(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    return df.withColumns({c: clamp_value(c, low, high) for c, (low, high) in bounds.items()})


def clamp_at_percentiles(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98,
                         exact: bool = True) -> DataFrame:
    bottom, top = quantiles(df, column, [low, high], exact=exact)
    return clamp(df, {column: (bottom, top)})


def boxplot_stats(df: DataFrame, column: str, by: Sequence[str], digits: int = 4) -> DataFrame:
    """Quartiles, fences at 1.5 times the quartile distance, and number of rows outside them, per group.

    Rows are counted by group and value before fences are joined, so a hot group is as many rows as it has values.
    The null group counts like any other.
    """
    by = list(by)
    wide = quantile_table(df, column, [0.25, 0.5, 0.75], by).groupBy(*by).agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n)
          for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    spread = F.col("q3") - F.col("q1")
    fences = wide.withColumns({"low_fence": F.col("q1") - 1.5 * spread, "high_fence": F.col("q3") + 1.5 * spread})
    stats = ["q1", "median", "q3", "low_fence", "high_fence"]
    rows = df.where(F.col(column).isNotNull()).select(*by, column)
    counted = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    joined = null_safe_join(counted, fences, by)
    outside = (F.col(column) < F.col("low_fence")) | (F.col(column) > F.col("high_fence"))
    return joined.groupBy(*by).agg(
        *[F.round(F.max(s), digits).alias(s) for s in stats],
        F.sum(F.when(outside, F.col("_n")).otherwise(0)).cast("bigint").alias("n_outlier"))


def impute(df: DataFrame, how: Mapping[str, object]) -> DataFrame:
    """Fill nulls per column with ``'mode'``, ``'median'``, ``'mean'`` or a given constant."""
    filled = {}
    for column, method in how.items():
        if method == "mode":
            row = mode_of(df, column).first()
            value = row[0] if row else None
        elif method == "median":
            value = quantiles(df, column, [0.5])[0]
        elif method == "mean":
            value = df.agg(F.avg(column)).first()[0]
        else:
            value = method
        filled[column] = F.coalesce(F.col(column), F.lit(value))
    return df.withColumns(filled)


def levels(df: DataFrame, column: str) -> list:
    """Sorted distinct non-null values of a categorical column; an error beyond ``MAX_LEVELS``."""
    found = df.where(F.col(column).isNotNull()).select(column).distinct().limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{column} has too many levels for dummy columns")
    return sorted(row[0] for row in found)


def binary_encode(df: DataFrame, column: str) -> DataFrame:
    """Two-level category to 0 (first level in sort order) and 1."""
    first, last, others = df.agg(F.min(column), F.max(column), F.count_distinct(column)).first()
    if others != 2:
        raise ValueError(f"{column} has {others} levels, not two")
    return df.withColumn(column, F.when(F.col(column) == first, 0).when(F.col(column) == last, 1))


def dummies_long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The ones of a dummy coding as rows ``(key, dummy)``, for categories of any number of levels. Nulls have no row."""
    cells = F.array(*[F.struct(F.lit(f"{c}_").alias("name"), F.col(c).cast("string").alias("level")) for c in columns])
    return df.select(key, F.inline(cells)).where(F.col("level").isNotNull()).select(key, F.concat("name", "level").alias("dummy"))


def dummies(df: DataFrame, columns: Sequence[str], drop_first: bool = True) -> DataFrame:
    """Replace categories by 0/1 columns ``<column>_<level>``; the first sorted level is the reference."""
    new: dict[str, Column] = {}
    for c in columns:
        for level in levels(df, c)[1 if drop_first else 0:]:
            new[f"{c}_{level}"] = (F.col(c) == F.lit(level)).cast("int")
    return df.withColumns(new).drop(*columns)


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and divide by the sample standard deviation; a constant column becomes null."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                   *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: F.try_divide(F.col(c) - stats[f"m_{c}"], F.lit(stats[f"s_{c}"])) for c in columns})


def rescale(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 255.0) -> DataFrame:
    """Map the fixed range ``low`` to ``high`` onto 0 to 1."""
    return df.withColumns({c: (F.col(c) - low) / (high - low) for c in columns})


def rescale_array(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.withColumn(column, F.transform(column, lambda x: (x.cast("double") - low) / (high - low)))


def quantile_edges(df: DataFrame, column: str, n: int = 10, exact: bool = True) -> list[float]:
    """Distinct edges of ``n`` bins that hold about equally many rows."""
    edges = quantiles(df, column, [i / n for i in range(n + 1)], exact=exact)
    return sorted({e for e in edges if e is not None})


def quantile_bins(df: DataFrame, column: str, n: int = 10, out: str = "bin", exact: bool = True) -> DataFrame:
    """Number 1.. of the right-closed equal-frequency bin; the lowest value belongs to the first one."""
    edges = quantile_edges(df, column, n, exact)
    if len(edges) < 2:
        return df.withColumn(out, F.when(F.col(column).isNotNull(), 1).cast("bigint"))
    names = [str(i + 1) for i in range(len(edges) - 1)]
    return df.withColumn(out, cut(column, edges, names, include_lowest=True).cast("bigint"))


__all__ = ["binary_encode", "boxplot_stats", "clamp", "clamp_at_percentiles", "cut_labels", "dummies", "dummies_long", "impute",
           "levels", "quantile_bins", "quantile_edges", "rescale", "rescale_array", "zscore"]
