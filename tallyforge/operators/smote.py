"""Oversampling of a rare class by interpolation between near neighbours.

Equal rows are merged first and keep a multiplicity, so many copies of one row cost no more than one. The neighbours of the distinct rows
are exact, see ``neighbours``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.neighbours import BLOCK_ROWS, nearest_rows
from tallyforge.operators.sampling import sample_n

CHUNK = 10_000


def smote(df: DataFrame, label: str, key: str, numeric: Sequence[str], categorical: Sequence[str] = (),
          over: int = 200, under: int = 200, k: int = 5, seed: int = 0, minority: object = None,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``over`` per cent synthetic rows of the rare class and keep ``under`` per cent of their number of the others.

    Distances use features scaled by their range, and 1 for each category that differs. A synthetic row lies at a
    hash-chosen point between a row and one of its ``k`` neighbours; each of its categories is
    taken from either end. When more rows of the other class are asked for than exist, all
    are taken as often as they fit and the rest is sampled. Returns the features and the label.
    """
    if over < 100 or over % 100:
        raise ValueError("over is a multiple of 100")
    times = over // 100
    numeric, categorical = list(numeric), list(categorical)
    df = df.select(key, label, *[F.col(c).cast("double").alias(c) for c in numeric], *categorical)
    if minority is None:
        minority = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy("n", label).first()[0]
    rare, rest = df.where(F.col(label) == F.lit(minority)), df.where(F.col(label) != F.lit(minority))

    stats = rare.agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"lo_{c}") for c in numeric],
                     *[F.max(c).alias(f"hi_{c}") for c in numeric]).first()
    if not stats["n"]:
        return df.select(*numeric, *categorical, label).limit(0)
    width = {c: (stats[f"hi_{c}"] - stats[f"lo_{c}"]) or 1.0 for c in numeric}
    scaled = [(F.col(c) - stats[f"lo_{c}"]) / width[c] for c in numeric]
    vectors = rare.select(
        (F.array(*scaled) if numeric else F.array().cast("array<double>")).alias("num"),
        (F.array(*[F.col(c).cast("string") for c in categorical]) if categorical
         else F.array().cast("array<string>")).alias("cat"))
    points = vectors.groupBy("num", "cat").agg(F.count(F.lit(1)).alias("mult")).withColumn(
        "vid", F.xxhash64("num", "cat"))
    near = nearest_rows(points, len(numeric), len(categorical), k, block_rows)
    # copies of a row are its nearest neighbours; the others follow, each as often as it occurs
    upto = W.partitionBy("vid").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    ladder = near.withColumn("upto", F.sum("n_mult").over(upto)).groupBy("vid").agg(
        F.sort_array(F.collect_list(F.struct("place", "upto", "n_num", "n_cat"))).alias("near"))
    base = points.join(ladder, "vid", "left")

    # spell out one row per synthetic one, in chunks so that many copies of a row are not one task's work
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("mult") * times - 1) / CHUNK)))
    chunked = base.withColumn("_chunk", chunk).repartition(F.col("vid"), F.col("_chunk"))
    last = F.least(F.col("mult") * times, (F.col("_chunk") + 1) * CHUNK) - 1
    rows = chunked.withColumn("_nr", F.explode(F.sequence(F.col("_chunk") * CHUNK, last)))

    def unit(*what: object) -> Column:
        h = F.xxhash64(F.lit(seed), F.col("vid"), F.col("_nr"), *[F.lit(w) for w in what])
        return F.pmod(h, F.lit(1 << 52)) / float(1 << 52)

    available = F.col("mult") - 1 + F.coalesce(F.get(F.col("near"), F.size("near") - 1)["upto"], F.lit(0))
    rows = rows.withColumn("_pick", F.floor(unit("pick") * F.least(F.lit(k), F.greatest(available, F.lit(1)))))
    beyond = F.col("_pick") - (F.col("mult") - 1)
    rows = rows.withColumn("_mate", F.when(beyond >= 0, F.get(F.filter("near", lambda x: x["upto"] > beyond), F.lit(0))))
    rows = rows.withColumn("_u", unit("step"))

    def number(i: int, c: str) -> Column:
        own = F.get("num", F.lit(i))
        mate = F.coalesce(F.get(F.col("_mate")["n_num"], F.lit(i)), own)
        return (stats[f"lo_{c}"] + width[c] * (own + F.col("_u") * (mate - own))).alias(c)

    def category(i: int, c: str) -> Column:
        own = F.get("cat", F.lit(i))
        mate = F.coalesce(F.get(F.col("_mate")["n_cat"], F.lit(i)), own)
        return F.when(unit("level", i) < 0.5, own).otherwise(mate).cast(dict(df.dtypes)[c]).alias(c)

    made = rows.select(*[number(i, c) for i, c in enumerate(numeric)], *[category(i, c) for i, c in enumerate(categorical)],
                       F.lit(minority).cast(dict(df.dtypes)[label]).alias(label))
    columns = [*numeric, *categorical, label]
    wanted = stats["n"] * times * under // 100
    there = rest.count()
    whole, part = divmod(wanted, there) if there else (0, 0)
    kept = rare.select(*columns).unionByName(made)
    if part:
        kept = kept.unionByName(sample_n(rest, key, part, seed).select(*columns))
    if whole:
        copies = F.explode(F.sequence(F.lit(1), F.lit(whole)))
        kept = kept.unionByName(rest.withColumn("_copy", copies).select(*columns))
    return kept

