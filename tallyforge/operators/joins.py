"""Joins and lookups.

Table sizes are left to Spark's own broadcast threshold. A broadcast is asked for here only where the
number of rows is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_PARTS = 4096  # portions of the rows without a key


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   few: bool = False) -> DataFrame:
    """Join on keys of the same name where null matches null; the keys appear once. ``few`` marks a
    right side whose size is bounded by construction.
    """
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for key, name in names.items():
        condition = condition & F.col(key).eqNullSafe(F.col(name))
    return left.join(F.broadcast(right) if few else right, condition, how).drop(*names.values())


def small_table(df: DataFrame, limit: int) -> DataFrame | None:
    """A table of at most ``limit`` rows, read once and put into the plan; None if it is larger."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], df.schema)


def lookup_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Add the columns of ``dim`` to a far larger ``fact`` by ``key``, once for each matching row of ``dim``.

    Both sides reach the join by a plain shuffle, so adaptive execution splits the partition of a hot key. Rows without a key match
    nothing; a left join deals them out by a hash of the row instead of sending them all to one task.
    """
    if how not in ("inner", "left"):
        raise ValueError("a lookup is an inner or left join")
    if how == "inner":
        return fact.where(F.col(key).isNotNull()).join(dim, key)
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*fact.columns), F.lit(NULL_PARTS)) + 1).otherwise(F.lit(0))
    return fact.withColumn("_spread", spread).join(dim.withColumn("_spread", F.lit(0).cast("bigint")), [key, "_spread"], "left").drop("_spread")


def merge_all(frames: Sequence[DataFrame], key: str | Sequence[str]) -> DataFrame:
    """Inner merge of several tables on one key; they share a partitioning, so each is shuffled once."""
    on = [key] if isinstance(key, str) else list(key)
    return reduce(lambda left, right: left.join(right, on, "inner"), frames)


def merge_checked(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Inner merge of two tables that share columns beyond the key.

    Returns the merged rows, each shared column once (the right-hand copy), and a table with
    the number of rows in which the two copies differ.
    """
    shared = [c for c in left.columns if c in right.columns and c != key]
    both = left.withColumnsRenamed({c: f"{c}_x" for c in shared}).join(
        right.withColumnsRenamed({c: f"{c}_y" for c in shared}), key, "inner")
    differs = [F.count(F.when(~F.col(f"{c}_x").eqNullSafe(F.col(f"{c}_y")), 1)).alias(c) for c in shared]
    conflicts = both.agg(*differs).unpivot([], shared, "column_name", "n_conflict")
    merged = both.drop(*[f"{c}_x" for c in shared]).withColumnsRenamed({f"{c}_y": c for c in shared})
    return merged, conflicts


def map_values(column: Column | str, mapping: Mapping[str, object]) -> Column:
    """Replace listed values, keep all others. The mapping is part of the plan, nothing is joined."""
    column = F.col(column) if isinstance(column, str) else column
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, column), column)


def onehot_labels(matrix: DataFrame, key: str) -> DataFrame:
    """Turn a 0/1 matrix with one column per label into ``(key, label)`` rows."""
    labels = [c for c in matrix.columns if c != key]
    return matrix.unpivot(key, labels, "label", "_on").where("_on = 1").drop("_on")


def onehot_lookup(df: DataFrame, matrix: DataFrame, key: str) -> DataFrame:
    """Attach the label whose matrix column is 1; keys without one get null."""
    return df.join(onehot_labels(matrix, key), key, "left")


def repair_na_spelling(column: Column) -> Column:
    """Undo a global replacement of ``na`` by ``0`` in names; a ``0`` next to a digit or after a point is genuine."""
    return F.regexp_replace(F.lower(column), r"(?<![0-9.])0(?![0-9])", "na")


def semi_join_top(df: DataFrame, members: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows whose key is among ``members``, a table of at most ``limit`` rows."""
    return df.join(F.broadcast(members.select(key).limit(limit)), key, "left_semi")
