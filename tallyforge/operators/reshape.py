"""Stacking, differences and long/wide reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def stack_tagged(frames: Mapping[object, DataFrame], name: str) -> DataFrame:
    """Stack tables and remember in ``name`` where each row came from."""
    return stack(*[df.withColumn(name, F.lit(tag)) for tag, df in frames.items()])


def setdiff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def pivot_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """One count column per value; the values are given, so no extra job looks for them."""
    counted = df.groupBy(*keys).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return counted.select(*keys, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(v) for v in values])


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def demand_supply_gap(df: DataFrame, keys: Sequence[str], status: str, served: str) -> DataFrame:
    """All requests, served requests and their difference per group."""
    served_rows = F.count(F.when(F.col(status) == served, 1))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("demand"), served_rows.alias("supply"),
        (F.count(F.lit(1)) - served_rows).alias("gap"))


def wide_days(df: DataFrame, key: str, day: Column, measure: Column, days: Sequence[str]) -> DataFrame:
    """One row per key and one column per listed day."""
    return df.withColumn("_day", day).groupBy(key).pivot("_day", list(days)).agg(measure)


def interval_hours(starts: DataFrame, ends: DataFrame, key: str, days: Sequence[str]) -> DataFrame:
    """Hours between two wide tables cell by cell, as rows ``(key, day, hours)``; missing cells stay null.

    The wide rows are joined on the key before they are spelled out, so each table
    is shuffled once by key and later aggregates by key need no shuffle.
    """
    cells = [F.col(f"`{d}`") for d in days]
    left = starts.select(key, F.array(*cells).alias("start_at"))
    right = ends.select(key, F.array(*cells).alias("end_at"))
    names = F.array(*[F.lit(d) for d in days]).alias("day")
    long = left.join(right, key).select(key, F.inline(F.arrays_zip(names, "start_at", "end_at")))
    hours = F.timestamp_diff("SECOND", F.col("start_at"), F.col("end_at")) / 3600.0
    return long.select(key, "day", hours.alias("hours"))


def row_mean_and_gaps(long: DataFrame, key: str, value: str, digits: int = 4) -> DataFrame:
    """Mean of the present values and number of missing ones per key."""
    return long.groupBy(key).agg(
        F.round(F.avg(value), digits).alias("mean_value"),
        F.count(F.when(F.col(value).isNull(), 1)).alias("n_missing"))


def active_days(long: DataFrame, day: str, value: str) -> DataFrame:
    """Days on which at least one value is present."""
    return long.groupBy(day).agg(F.count(value).alias("n_present")).where("n_present > 0")


def attendance_features(long: DataFrame, key: str, value: str, standard: float = 8, digits: int = 4) -> DataFrame:
    """Mean hours, absences, and flags for a mean above or below the standard."""
    base = long.groupBy(key).agg(F.avg(value).alias("_mean"), F.count(F.when(F.col(value).isNull(), 1)).alias("n_missing"))
    return base.select(key, F.round("_mean", digits).alias("mean_value"), "n_missing",
                       (F.col("_mean") > standard).cast("int").alias("over_time"),
                       (F.col("_mean") < standard).cast("int").alias("short_time"))


def attendance_present(present: DataFrame, key: str, value: str, n_days: Column | int, standard: float = 8, digits: int = 4) -> DataFrame:
    """As ``attendance_features``, from rows of present days only; ``n_days`` is the length of the calendar."""
    days = n_days if isinstance(n_days, Column) else F.lit(n_days)
    base = present.groupBy(key).agg(F.avg(value).alias("_mean"), F.count(value).alias("_present"))
    return base.select(key, F.round("_mean", digits).alias("mean_value"), (days - F.col("_present")).cast("bigint").alias("n_missing"),
                       (F.col("_mean") > standard).cast("int").alias("over_time"),
                       (F.col("_mean") < standard).cast("int").alias("short_time"))
