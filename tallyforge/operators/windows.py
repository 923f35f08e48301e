"""Ranking inside groups, top-k and ordered extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k_per(df: DataFrame, part: Sequence[str], item: Sequence[str], k: int, name: str = "n_rows") -> DataFrame:
    """The items of each partition whose count ranks among the ``k`` largest; ties are kept.

    Counts are aggregated first, and Spark cuts each task's share to the top ranks before the shuffle.
    """
    counts = df.groupBy(*part, *item).agg(F.count(F.lit(1)).alias(name))
    span = W.partitionBy(*part).orderBy(F.col(name).desc())
    return counts.withColumn("rnk", F.dense_rank().over(span)).where(F.col("rnk") <= k).withColumn(
        "rnk", F.col("rnk").cast("bigint"))


def row_index_per(df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int, name: str = "idx") -> DataFrame:
    """Number the rows of each partition in a total order and keep the first ``k``."""
    span = W.partitionBy(*part).orderBy(*order)
    return df.withColumn(name, F.row_number().over(span)).where(F.col(name) <= k).withColumn(
        name, F.col(name).cast("bigint"))


def top_members(df: DataFrame, dim: str, measure: Column, n: int, exclude: Sequence[object] = ()) -> DataFrame:
    """The ``n`` non-null members of a dimension with the largest aggregate."""
    kept = df.where(F.col(dim).isNotNull())
    if exclude:
        kept = kept.where(~F.col(dim).isin(list(exclude)))
    return kept.groupBy(dim).agg(measure.alias("measure")).orderBy(F.col("measure").desc(), dim).limit(n)


def last_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows in ``order``, given in that order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)


def cumulative(df: DataFrame, order: str, column: str, name: str) -> DataFrame:
    """Running sum over an aggregated table of few rows, such as deciles.

    For tables that grow with the data use ``ranking.running_totals``.
    """
    return df.withColumn(name, F.sum(column).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def priced_top_k(df: DataFrame, key: str, prices: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Count times unit price for the ``k`` most frequent keys (per group); ties by key."""
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n_rows"))
    order = [F.col("n_rows").desc(), F.col(key)]
    if by:
        top = row_index_per(counts, by, order, k, "_idx").drop("_idx")
    else:
        top = counts.orderBy(*order).limit(k)
    return top.join(prices, key, "left").withColumn("amount", F.col("n_rows") * F.col("price"))
