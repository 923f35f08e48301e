"""Summaries that are stored per part of a table and merged over any parts later, without reading the rows again.

Quantiles are KLL sketches, distinct counts HyperLogLog sketches, frequent values the counters of a frequent-items sketch. All are a few
kilobytes per part however many rows it has, and merging them in any order has the error of one sketch over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch; its rank error is below two in hundred with 99 % certainty.
QUANTILE_K, RANK_ERROR = 200, 0.02
#: Bits of a distinct sketch; its relative standard error is 1.04 / sqrt(2 ** 12), under two in hundred.
DISTINCT_BITS, DISTINCT_ERROR = 12, 0.05
#: Counters of a frequent-items sketch, and how many of them are asked for.
COUNTERS = 1024


def summarise(df: DataFrame, by: Sequence[str], quantiles: Sequence[str] = (), distinct: Sequence[str] = (), frequent: Sequence[str] = ()) -> DataFrame:
    """One row per part ``by`` with ``n`` and a sketch ``<column>_quantiles``, ``_distinct`` or ``_frequent`` of each column; nulls are left out.

    All sketches come from one aggregate; tasks sketch their own rows, so what is shuffled are sketches.
    """
    wide = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(QUANTILE_K)).alias(f"{c}_quantiles") for c in quantiles]
    counted = [F.hll_sketch_agg(F.col(c), F.lit(DISTINCT_BITS)).alias(f"{c}_distinct") for c in distinct]
    common = [F.call_function("approx_top_k_accumulate", F.col(c), F.lit(COUNTERS)).alias(f"{c}_frequent") for c in frequent]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *wide, *counted, *common)


def merge(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summaries of larger parts from those of smaller ones: the same columns, by ``by``."""
    def merged(c: str) -> Column:
        if c.endswith("_quantiles"):
            return F.kll_merge_agg_double(c)
        if c.endswith("_distinct"):
            return F.hll_union_agg(c)
        return F.call_function("approx_top_k_combine", F.col(c), F.lit(COUNTERS))

    sketches = [c for c in parts.columns if c.endswith(("_quantiles", "_distinct", "_frequent"))]
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *[merged(c).alias(c) for c in sketches])


def quantile(column: str, share: float) -> Column:
    """The value at a share of the ranks of a merged quantile sketch."""
    return F.kll_sketch_get_quantile_double(f"{column}_quantiles", F.lit(share))


def rank(column: str, value: Column) -> Column:
    """The share of values up to one."""
    return F.kll_sketch_get_rank_double(f"{column}_quantiles", value)


def distinct_count(column: str) -> Column:
    return F.hll_sketch_estimate(f"{column}_distinct")


def frequent_values(column: str, k: int) -> Column:
    """The ``k`` most frequent values with their estimated counts, an array of ``item, count``; a count is never too small by more than what
    the sketch had to throw out, at most rows / ``COUNTERS``."""
    return F.call_function("approx_top_k_estimate", F.col(f"{column}_frequent"), F.lit(k))
