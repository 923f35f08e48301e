"""Sharding by jump consistent hashing, with gapless row slots inside every shard.

Jump hashing walks a pseudo-random sequence that only the key decides; the last jump below the shard count is the shard. No
ring table is kept, and one more shard takes rows only into itself. The sequence is the published 64-bit
congruential one, written in decimals because Spark's ANSI integers do not wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import materialise

# Multiplier of the congruential sequence, its modulus, and the two powers of the jump formula.
MULTIPLIER = "2862933555777941757"
MODULUS = "18446744073709551616"
HIGH_BITS = "8589934592"
JUMP_RANGE = "2147483648D"


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, 0 to ``shards - 1``. A null key counts as 0, a negative one as its unsigned value.

    The number of jumps is about ``ln(shards)``, but a key may need up to ``shards`` of them, so that many steps are
    written down; steps after the last jump do nothing.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    unsigned = F.pmod(F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)"), F.expr(f"{MODULUS}BD"))
    start = F.struct(unsigned.cast("decimal(20,0)").alias("state"), F.lit(-1).cast("bigint").alias("shard"),
                     F.lit(0).cast("bigint").alias("next"))

    def step(walk: Column, _: Column) -> Column:
        state = F.pmod(walk["state"] * F.expr(f"{MULTIPLIER}BD") + F.lit(1).cast("decimal(1,0)"),
                       F.expr(f"{MODULUS}BD")).cast("decimal(20,0)")
        high = F.floor(state / F.expr(f"{HIGH_BITS}BD")).cast("bigint") + F.lit(1)
        jump = F.floor((walk["next"] + 1).cast("double") * (F.expr(JUMP_RANGE) / high.cast("double"))).cast("bigint")
        moved = F.struct(state.alias("state"), walk["next"].alias("shard"), jump.alias("next"))
        return F.when(walk["next"] < shards, moved).otherwise(walk)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda walk: walk["shard"]).cast("int")


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard now, its shard with one more, and its slot in the shard, counted from 0 by key.

    Returns ``key, size, text_crc32, law, shard, slot, grown_shard``. A null text has no bytes; a null key goes where 0
    goes and comes first. Repeated rows share a shard and have slots of their own. Other columns of ``docs`` are not read.
    An empty table gives an empty result.

    The slots need no task that holds a whole shard: narrow rows are cut into key ranges, written, and numbered inside
    (range, shard); a small table of counts supplies the offsets. Rows with one key are spread over ranges by the rest.
    """
    octets = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    narrow = docs.select(
        F.col(key).cast("bigint").alias(key), (F.octet_length(octets) + 1).cast("bigint").alias("size"),
        F.crc32(octets).alias("text_crc32"), jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("_row"))
    order = [key, "text_crc32", "size", "_row"]
    rows = materialise(narrow, "shard-rows")
    rows = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "shard-ranges")

    counts = rows.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", "shard").orderBy(*order)) - 1
    numbered = rows.withColumn("_inside", inside).join(offsets, ["shard", "_range"])
    return numbered.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                           (F.col("_before") + F.col("_inside")).cast("bigint").alias("slot"), "grown_shard")
