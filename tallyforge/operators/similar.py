"""Similarity join of distinct texts by edit distance, without comparing all pairs.

Texts within ``distance`` edits of each other share all but ``q * distance`` of their q-grams. In one order of all q-grams, the rarest
first, the first ``q * distance + 1`` of either therefore hold a common one; only those are indexed. Texts too short for that share a text
that both become by taking out at most ``distance`` letters. Candidates of both kinds are decided by the edit distance itself.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import materialise

Q = 3


def _grams(text: Column, q: int) -> Column:
    """All q-grams of a text, told apart by how often they came before in it."""
    every = F.transform(F.sequence(F.lit(1), F.char_length(text) - (q - 1)), lambda i: F.substring(text, i, F.lit(q)))
    return F.transform(every, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(every, F.lit(1), i), lambda x: x == g)).alias("nr")))


def _deleted(distance: int):
    @F.pandas_udf("array<string>")
    def deleted(texts: pd.Series) -> pd.Series:
        def make(t: str) -> list[str]:
            return list({"".join(c for i, c in enumerate(t) if i not in gone)
                         for n in range(min(distance, len(t)) + 1) for gone in combinations(range(len(t)), n)})
        return texts.map(make)
    return deleted


def similar_pairs(values: DataFrame, column: str, distance: int = 1, q: int = Q) -> DataFrame:
    """``a, b, distance`` of all pairs of distinct texts of a column within ``distance`` edits, ``a`` before ``b``. Nulls have no pair.

    An edit inserts, deletes or replaces a letter. Texts of a length that differs by more are no candidates.
    """
    texts = materialise(values.where(F.col(column).isNotNull()).select(F.col(column).alias("t")).distinct(), "similar-texts")
    long = F.char_length("t") - (q - 1) > q * distance
    grams = materialise(texts.where(long).select("t", F.explode(_grams(F.col("t"), q)).alias("g")), "similar-grams")
    times = grams.groupBy("g").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # a q-gram that no other text holds leads nowhere, but takes its place in the order
    ranked = grams.join(times, "g", "left").groupBy("t").agg(F.slice(F.array_sort(F.collect_list(
        F.struct(F.coalesce("times", F.lit(1)).alias("times"), "g"))), 1, q * distance + 1).alias("first"))
    prefix = ranked.select("t", F.explode("first").alias("f")).where("f.times > 1").select("t", F.col("f.g").alias("key"))
    # a short text may be near one that is long enough by as many letters
    short = texts.where(F.char_length("t") - (q - 1) <= q * distance + distance)
    spelled = short.select("t", F.explode(_deleted(distance)("t")).alias("key"))
    pairs = [keys.select(F.col("t").alias("a"), "key").join(keys.select(F.col("t").alias("b"), "key"), "key").where(
        (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= distance)).select("a", "b")
        for keys in (materialise(prefix, "similar-keys"), materialise(spelled, "similar-keys"))]
    met = pairs[0].unionByName(pairs[1]).distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", distance)).where("distance >= 0")


def value_map(values: DataFrame, column: str, distance: int = 1, factor: float = 10, q: int = Q) -> DataFrame:
    """``value, mapped``: texts that stand for a near one at least ``factor`` times as frequent, the most frequent, of equal ones the first.

    Chains are followed to their end, so the result can be joined at once; the end of a chain is more frequent by the factor at every step, so there
    are no circles.
    """
    counts = materialise(values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("t")).agg(F.count(F.lit(1)).alias("n")), "similar-counts")
    pairs = similar_pairs(counts, "t", distance, q)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sized = both.join(counts.select(F.col("t").alias("a"), F.col("n").alias("a_n")), "a").join(
        counts.select(F.col("t").alias("b"), F.col("n").alias("b_n")), "b").where(F.col("b_n") >= factor * F.col("a_n"))
    chosen = sized.groupBy("a").agg(F.min(F.struct((-F.col("b_n")).alias("order"), "b")).alias("best"))
    reach = materialise(chosen.select(F.col("a").alias("value"), F.col("best.b").alias("mapped")), "similar-map")
    while True:
        further = reach.select(F.col("value").alias("mapped"), F.col("mapped").alias("next"))
        if not reach.join(further, "mapped", "left_semi").limit(1).count():
            return reach
        reach = materialise(reach.join(further, "mapped", "left").select("value", F.coalesce("next", "mapped").alias("mapped")), "similar-map")
