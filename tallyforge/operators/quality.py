"""Data-quality operators: rules, null and domain profiles, duplicates, keys.

All profiles are one aggregate over the table, whatever the number of columns or rules.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Mapping[str, Column]


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def any_rule(rules: Rules) -> Column:
    """True when any rule holds. A rule whose input is null neither holds nor fails."""
    result = F.lit(False)
    for rule in rules.values():
        result = result | rule
    return result


def all_rules(rules: Rules) -> Column:
    result = F.lit(True)
    for rule in rules.values():
        result = result & rule
    return result


def fault_counts(df: DataFrame, rules: Rules, by: Sequence[str]) -> DataFrame:
    """Rows per group that break at least one rule, with a count per rule."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), _n(any_rule(rules)).alias("faulty"),
        *[_n(rule).alias(f"faulty_{name}") for name, rule in rules.items()])


def fault_rate(df: DataFrame, rules: Rules, by: Sequence[str], digits: int = 4) -> DataFrame:
    """Per cent of a group's rows that break at least one rule."""
    flag = F.when(any_rule(rules), 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.round(100 * F.avg(flag), digits).alias("fault_pct"))


def keep_clean(df: DataFrame, positive_rules: Rules) -> DataFrame:
    """Rows for which every positive rule holds; rows with null inputs are not kept."""
    return df.where(all_rules(positive_rules))


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """One row per rule with the number of rows that break it."""
    wide = df.agg(*[_n(rule).alias(name) for name, rule in rules.items()])
    return wide.unpivot([], list(rules), "rule", "n_rows")


def domain_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value and number of nulls of each numeric column."""
    measures = []
    for c in columns:
        measures.append(F.struct(F.lit(c).alias("column_name"), F.min(c).cast("double").alias("min_value"),
                                 F.max(c).cast("double").alias("max_value"),
                                 _n(F.col(c).isNull()).alias("n_null")).alias(c))
    return df.agg(F.array(*measures).alias("_all")).select(F.inline("_all"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with no null and no empty string in ``columns``."""
    types = dict(df.dtypes)
    columns = list(columns or df.columns)
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
        if types[c] == "string":
            condition = condition & (F.col(c) != "")
    return df.where(condition)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with its number of nulls."""
    columns = list(columns or df.columns)
    return df.agg(*[_n(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], columns, "column_name", "n_null")


def blank_profile(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Empty strings per text column, as a count and in per cent of all rows."""
    columns = list(columns or [c for c, t in df.dtypes if t == "string"])
    counts = [F.struct(F.lit(c).alias("column_name"), _n(F.col(c) == "").alias("n_blank"),
                       F.round(100.0 * _n(F.col(c) == "") / F.count(F.lit(1)), digits).alias("blank_pct")).alias(c)
              for c in columns]
    return df.agg(F.array(*counts).alias("_all")).select(F.inline("_all"))


def null_by_label(df: DataFrame, column: str, label: str) -> DataFrame:
    """Where ``column`` is null, how often each label occurs."""
    return df.where(F.col(column).isNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_null"))


def dedupe(df: DataFrame, key: str | Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: any row, or the first one in ``order``.

    Both ways keep one row per key and task before the shuffle, so a key with very many copies
    does not meet in one place.
    """
    key = [key] if isinstance(key, str) else list(key)
    if not order:
        return df.dropDuplicates(key)
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(first).select(*key, "_row.*").select(*df.columns)


def uniqueness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values and surplus copies per column.

    Each column is reduced to its distinct values by its own two-step aggregate; several distinct counts in a
    single aggregate would copy every row once per column.
    """
    parts = []
    for c in columns:
        per_value = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(per_value.agg(
            F.lit(c).alias("column_name"), F.count(c).alias("n_distinct"),
            (F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("_n"))), F.lit(0)) - F.count(c)).alias("n_duplicate")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def assert_unique_key(df: DataFrame, key: str | Sequence[str]) -> None:
    """Raise when ``key`` does not identify rows; one example reaches the driver."""
    key = [key] if isinstance(key, str) else list(key)
    twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} is not unique, for example {twice[0].asDict()}")


def missing_keys(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks; each key travels once."""
    wanted = left.select(F.col(key)).distinct()
    present = right.select(F.col(right_key or key).alias(key)).distinct()
    return wanted.join(present, key, "left_anti")
