"""Grouped and whole-table aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.joins import null_safe_join
from tallyforge.operators.ranking import quantile_table

def count_by(df: DataFrame, keys: Sequence[str], name: str = "n_rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_distinct_by(df: DataFrame, column: str, keys: Sequence[str] = (), name: str = "n_distinct") -> DataFrame:
    """Exact distinct count per group: first one row per value, then a count, so no group sits in one set."""
    return df.select(*keys, column).distinct().groupBy(*keys).agg(F.count(column).alias(name))


def top_groups(df: DataFrame, keys: Sequence[str], measure: Column, k: int, name: str) -> DataFrame:
    """The ``k`` groups with the largest measure; ties by key. Only ``k`` rows per task are kept."""
    return df.groupBy(*keys).agg(measure.alias(name)).orderBy(F.col(name).desc(), *keys).limit(k)


def extreme_groups(df: DataFrame, keys: Sequence[str], measure: Column, name: str, largest: bool = True) -> DataFrame:
    """All groups whose measure equals the largest (or smallest) one; ties are kept."""
    grouped = df.groupBy(*keys).agg(measure.alias(name))
    bound = grouped.agg((F.max if largest else F.min)(name).alias("_bound")).scalar()
    return grouped.where(F.col(name) == bound)


def with_share(grouped: DataFrame, measure: str, name: str = "pct", digits: int = 2) -> DataFrame:
    """Add the share of the grand total in per cent to an aggregated table.

    The total is a scalar subquery, so groups stay spread over tasks.
    """
    total = grouped.agg(F.sum(measure).alias("_total")).scalar()
    return grouped.withColumn(name, F.round(100.0 * F.col(measure) / total, digits))


def rate_by(df: DataFrame, flag: Column, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """Rows, events and event rate per group."""
    flag = flag.cast("int")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(flag).cast("bigint").alias("n_events"),
        F.round(F.avg(flag), digits).alias("rate"))


def crosstab(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Contingency table in long form, one to many ways."""
    return count_by(df, dims)


def argmax(df: DataFrame, measure: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """The row with the largest measure, the smallest ``tie`` among equals; one row per task is shuffled."""
    return df.orderBy(F.col(measure).desc_nulls_last(), F.col(tie)).limit(1).select(*columns)


def argmax_many(df: DataFrame, measures: Sequence[str], out: str, tie: str) -> DataFrame:
    """For each measure the ``out`` of the row that has its maximum, all in one aggregate."""
    rows = [F.struct(F.lit(m).alias("measure"), F.max_by(out, F.struct(F.col(m), -F.col(tie))).alias("holder"),
                     F.max(m).cast("double").alias("max_value")).alias(m) for m in measures]
    return df.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))


def nth_largest(df: DataFrame, column: str, n: int) -> DataFrame:
    """All rows that hold the n-th largest distinct value."""
    ladder = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(F.col(column).desc()).limit(n)
    value = ladder.agg(F.when(F.count(F.lit(1)) == n, F.min(column)).alias("_value")).scalar()
    return df.where(F.col(column) == value)


def mode_of(df: DataFrame, column: str, n: int = 1) -> DataFrame:
    """Most frequent non-null value with its count; the smallest value wins a tie."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.col("n_rows").desc(), column).limit(n)


def summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Minimum, quartiles, mean, maximum and null count per column (and group)."""
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    result = None
    for c in columns:
        basic = df.groupBy(*by).agg(
            F.min(c).cast("double").alias("min_value"), F.round(F.avg(c), digits).alias("mean_value"),
            F.max(c).cast("double").alias("max_value"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_null"))
        spread = quantile_table(df, c, list(names), by).groupBy(*by).agg(
            *[F.round(F.max(F.when(F.col("q") == q, F.col("value"))), digits).alias(n) for q, n in names.items()])
        keyed = [*by, "column_name"]
        part = null_safe_join(basic.withColumn("column_name", F.lit(c)), spread.withColumn("column_name", F.lit(c)),
                              keyed, "left")
        part = part.select(*keyed, "min_value", "q1", "median", "mean_value", "q3", "max_value", "n_null")
        result = part if result is None else result.unionByName(part)
    return result


def share_of_total(df: DataFrame, key: str, column: str, digits: int = 4) -> DataFrame:
    """Sum, mean and share of the grand total per group."""
    grouped = df.groupBy(key).agg(F.sum(column).alias("_sum"), F.avg(column).alias("_avg"))
    shared = with_share(grouped, "_sum", "pct", digits)
    return shared.select(key, F.round("_sum", 2).alias("sum_value"), F.round("_avg", digits).alias("avg_value"), "pct")


def drilldown_worst(totals: DataFrame, detail: DataFrame, pick: str, by: str, measure: str, rows: Column | None = None,
                    digits: int = 2) -> DataFrame:
    """Take the member of ``pick`` with the smallest total and split its rows of ``detail`` by ``by``.

    ``totals`` has one row per member with its ``total`` and may come from a cheaper plan than ``detail``; the member found is
    a scalar, so the filter on it reaches the scans below ``detail``. ``rows`` counts rows, for input already aggregated.
    """
    chosen = totals.orderBy("total", pick).limit(1).select(pick).scalar()
    return detail.where(F.col(pick) == chosen).groupBy(pick, by).agg(
        (F.count(F.lit(1)) if rows is None else rows).alias("n_rows"), F.round(F.sum(measure), digits).alias("total"))


def sum_where(df: DataFrame, member: str, members: Sequence[object], column: str, digits: int = 2) -> DataFrame:
    """Total of ``column`` for each listed member, as rows ``(member, total)``; one pass, no grouping shuffle."""
    rows = [F.struct(F.lit(m).alias("member"),
                     F.round(F.sum(F.when(F.col(member) == m, F.col(column))), digits).alias("total")).alias(f"m{i}")
            for i, m in enumerate(members)]
    return df.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))


def avg_where(column: str, condition: Column) -> Column:
    return F.avg(F.when(condition, F.col(column)))


def avg_rate_per_hour(distance: Column, hours: Column) -> Column:
    """Mean of per-row rates; rows without elapsed time have no rate."""
    return F.avg(F.try_divide(distance.cast("double"), hours))


def corr_long(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pairwise correlations over complete rows, all pairs in one aggregate."""
    columns = list(columns)
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    rows = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(F.corr(a, b), digits).alias("r")).alias(f"{a}_{b}")
            for i, a in enumerate(columns) for b in columns[i + 1:]]
    return complete.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))
