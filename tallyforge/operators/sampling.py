"""Repeatable splits and samples.

Rows are chosen by a hash of their key, so the choice depends neither on partitioning nor on
the engine: the same rule can be written in any SQL that has MD5. A lost task recomputes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.joins import null_safe_join
from tallyforge.session import materialise

DIGITS = 8
ROWS_PER_SLICE = 500_000
MAX_SLICE_DIGITS = 5


def key_hash(key: Column | str, seed: int = 0) -> Column:
    """First eight hex digits of MD5 of ``key:seed``; as text they sort like the numbers they stand for."""
    key = F.col(key) if isinstance(key, str) else key
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, DIGITS)


def share_of_hashes(share: float) -> str:
    """The text below which about ``share`` of all hashes lie."""
    return "g" if share >= 1 else f"{int(max(share, 0) * 16 ** DIGITS):0{DIGITS}x}"


def split(df: DataFrame, key: str, ratio: float = 0.7, seed: int = 0, out: str = "part") -> DataFrame:
    """Label each row ``train`` with probability ``ratio``, else ``test``. Maps rows, shuffles nothing."""
    chosen = key_hash(key, seed) < share_of_hashes(ratio)
    return df.withColumn(out, F.when(chosen, "train").otherwise("test"))


def _cutoffs(df: DataFrame, key: str, by: Sequence[str], quota: Column, seed: int,
             rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Per stratum the hash and key of the last row inside the quota; any number of strata.

    Rows are counted per stratum and hash slice; only the slice in which the quota ends is ordered. There are as many
    slices as it takes to keep one at about ``ROWS_PER_SLICE`` rows, a single one for a small table.
    """
    rows = df.count()
    digits = min(MAX_SLICE_DIGITS, -(-(rows // rows_per_slice).bit_length() // 4))
    hashed = df.select(*by, F.col(key).alias("_key"), key_hash(key, seed).alias("_hash"))
    hashed = hashed.withColumn("_slice", F.substring("_hash", 1, digits) if digits else F.lit(""))
    sizes = hashed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by)
    upto = group.orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = sizes.select(*by, "_slice", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), "_n",
                        F.sum("_n").over(group).alias("_rows"))
    ends = ends.withColumn("_quota", quota).where(
        (F.col("_quota") > F.col("_before")) & (F.col("_quota") <= F.col("_before") + F.col("_n")))
    ends = ends.select(*by, "_slice", (F.col("_quota") - F.col("_before")).alias("_rest"))
    last = null_safe_join(hashed, ends, [*by, "_slice"])
    place = F.row_number().over(W.partitionBy(*by, "_slice").orderBy("_hash", "_key"))
    return last.withColumn("_place", place).where(F.col("_place") == F.col("_rest")).select(
        *by, F.col("_hash").alias("_cut_hash"), F.col("_key").alias("_cut_key"))


def _below_cutoff(df: DataFrame, key: str, seed: int) -> Column:
    h = key_hash(key, seed)
    return (h < F.col("_cut_hash")) | ((h == F.col("_cut_hash")) & (F.col(key) <= F.col("_cut_key")))


def stratified_split(df: DataFrame, key: str, by: str, ratio: float = 0.7, seed: int = 0, out: str = "part",
                     rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Exactly ``floor(ratio * n)`` training rows in every stratum, ``key`` being unique.

    The cut-offs, one row per stratum, are written and joined; Spark broadcasts them where they are small.
    """
    found = _cutoffs(df, key, [by], F.floor(F.col("_rows") * F.lit(ratio) + 1e-9), seed, rows_per_slice)
    kept = null_safe_join(df, materialise(found, "cutoffs"), [by], "left")
    chosen = F.coalesce(_below_cutoff(df, key, seed), F.lit(False))
    return kept.withColumn(out, F.when(chosen, "train").otherwise("test")).drop("_cut_hash", "_cut_key")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``n`` rows (all, if there are fewer) with the smallest key hashes; ``key`` is unique."""
    cut = _cutoffs(df, key, [], F.least(F.col("_rows"), F.lit(n)), seed,
                   rows_per_slice=rows_per_slice).first()
    if cut is None:
        return df.limit(0)
    h = key_hash(key, seed)
    return df.where((h < cut["_cut_hash"]) | ((h == cut["_cut_hash"]) & (F.col(key) <= cut["_cut_key"])))


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    return df.where(key_hash(key, seed) < share_of_hashes(fraction))
