"""The tables behind bar charts, stacked bars and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.aggregates import with_share


def bar_counts(df: DataFrame, x: str, *fill_and_facet: str) -> DataFrame:
    return df.groupBy(x, *fill_and_facet).agg(F.count(F.lit(1)).alias("n_rows"))


def bar_share(df: DataFrame, x: str, *facet: str, digits: int = 4) -> DataFrame:
    """Rows per bar and their share of all rows in per cent."""
    return with_share(bar_counts(df, x, *facet), "n_rows", "pct", digits)


def stack_share(df: DataFrame, x: str, fill: str, digits: int = 4) -> DataFrame:
    """Share of each fill within its bar.

    The bar totals come from a second aggregate of the counts, joined by bar, so a bar is never gathered in one place.
    """
    counts = bar_counts(df, x, fill)
    totals = counts.groupBy(F.col(x).alias("_bar")).agg(F.sum("n_rows").alias("_total"))
    joined = counts.join(totals, F.col(x).eqNullSafe(F.col("_bar")))
    return joined.select(x, fill, "n_rows", F.round(100.0 * F.col("n_rows") / F.col("_total"), digits).alias("pct"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest value."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        return df.select(F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("bigint").alias("n_rows")).limit(0)
    value = F.col(column).cast("double")
    number = F.lit(1) if low == high else F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return df.where(value.isNotNull()).groupBy(number.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def facets(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """One bar table per column."""
    return {c: bar_counts(df, c) for c in columns}


def bars_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every level of several columns as rows ``(column_name, level, n_rows)``, all from one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n_rows"))
