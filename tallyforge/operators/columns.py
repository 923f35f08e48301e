"""Schema and projection operators: names, types, derived and dropped columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_name(name: str) -> str:
    """Trim, blanks to underscores, no question marks, lower case."""
    return re.sub(r"\s", "_", name.strip()).replace("?", "").lower()


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_name(c) for c in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def derive(df: DataFrame, expressions: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(expressions))


def tag(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Change types; text that does not parse becomes null instead of an error."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def null_shares(df: DataFrame) -> dict[str, float]:
    """Share of nulls per column, from one pass; one number per column reaches the driver."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    rows = counts["_rows"]
    return {c: 1 - counts[c] / rows if rows else 0.0 for c in df.columns}


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop the columns in which every row is null."""
    return df.select(*[f"`{c}`" for c, share in null_shares(df).items() if share < 1])


def keep_by_null_share(df: DataFrame, limit: float = 0.05) -> DataFrame:
    """Keep the columns whose share of nulls is below ``limit``."""
    return df.select(*[f"`{c}`" for c, share in null_shares(df).items() if share < limit])


def bind_columns(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Put two tables side by side by key, never by position."""
    return left.join(right, [key] if isinstance(key, str) else list(key), "inner")


def shape(df: DataFrame) -> DataFrame:
    """Row and column count as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))
