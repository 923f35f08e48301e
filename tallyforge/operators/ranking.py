"""Running totals, row positions and exact percentiles over tables of any size.

A window without a partition key, or with one hot key, sorts all its rows in one task. Every function
here cuts the table into value ranges of about equal size, a small one into a single range: ranges are ranked or summed
on their own, and a small table of per-range totals (its size is fixed by the number of ranges, not by the data)
supplies the offset.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.joins import null_safe_join
from tallyforge.session import materialise

ROWS_PER_RANGE = 2_000_000   # rows (or distinct values) aimed at
MAX_RANGES = 20_000
DIRECT_VALUES = 50_000       # distinct values the built-in percentile may hold in one buffer
FINE_ROWS = 10_000_000_000   # beyond it the sketch is made finer
MAX_GROUPS = 10_000          # groups whose brackets may travel as a broadcast


def _range_count(size: int, rows_per_range: int) -> int:
    return max(1, min(MAX_RANGES, -(-size // rows_per_range)))


def percent_points(df: DataFrame, column: str, ranges: int) -> list[float]:
    """Approximate cut points, ``ranges - 1`` of them, repeated where one value fills several ranges."""
    shares = [i / ranges for i in range(1, ranges)]
    if not shares:
        return []
    points = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, max(1000, 8 * ranges))).first()[0]
    return [float(p) for p in points or []]


def into_ranges(df: DataFrame, column: str, edges: Sequence[float], out: str) -> DataFrame:
    """Number of the range ``[edge, next edge)`` each value falls in; the lookup runs inside the JVM."""
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    value = f"{out}_value"
    splits = [float("-inf"), *edges, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep")
    return cutter.transform(df.withColumn(value, F.col(column).cast("double"))).drop(value)


def running_totals(df: DataFrame, order_by: str, totals: Mapping[str, Column], by: Sequence[str] = (),
                   descending: bool = False, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per distinct ``(by, order_by)`` with each total and its running sum ``cum_<name>``.

    Rows sharing a value are added up first, so a value that holds a third of the table is one row by the time anything
    is ordered, and ranges are cut by distinct values. Nulls in ``order_by`` are left out.
    """
    by = list(by)
    rows = df.where(F.col(order_by).isNotNull())
    collapsed = materialise(rows.groupBy(*by, order_by).agg(*[F.sum(c).alias(n) for n, c in totals.items()]), "collapsed")
    edges = sorted(set(percent_points(collapsed, order_by, _range_count(collapsed.count(), rows_per_range))))
    ranged = into_ranges(collapsed, order_by, edges, "_range")
    per_range = ranged.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_sum_{n}") for n in totals])
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    earlier = W.partitionBy(*by).orderBy(range_order).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        *by, "_range", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals])
    order = F.col(order_by).desc() if descending else F.col(order_by).asc()
    within = W.partitionBy(*by, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = ranged.withColumns({f"_cum_{n}": F.sum(n).over(within) for n in totals})
    return null_safe_join(summed, offsets, [*by, "_range"]).select(
        *by, order_by, *totals,
        *[(F.col(f"_cum_{n}") + F.col(f"_before_{n}")).alias(f"cum_{n}") for n in totals])


def row_positions(df: DataFrame, score: str, key: str, descending: bool = True, out: str = "position",
                  rows_per_range: int = ROWS_PER_RANGE, rows: int | None = None) -> DataFrame:
    """1-based position of every row in ``score`` order, ties broken by the unique numeric ``key``.

    ``rows`` is the number of rows where it is known. With a single range nothing lies before it, so no totals are taken. A score that fills several ranges by itself (hard 0/1 scores, for example) is cut
    further along the key, so no task gets more than about one range.
    """
    order = [F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last(), F.col(key).asc()]
    ranges = _range_count(df.count() if rows is None else rows, rows_per_range)
    if ranges == 1:
        return df.withColumn(out, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint"))
    points = percent_points(df, score, ranges)
    edges = sorted(set(points))
    repeats = Counter(points)
    weight = [repeats[e] for e in edges]
    key_edges = sorted(set(percent_points(df, key, ranges)))
    cut = into_ranges(into_ranges(df, score, edges, "_range"), key, key_edges, "_key_range")
    slot = F.col("_range").cast("int")
    edge_value = F.get(F.lit(edges).cast("array<double>"), slot - 1)
    edge_weight = F.get(F.lit(weight).cast("array<int>"), slot - 1)
    on_edge = (slot >= 1) & F.col(score).cast("double").eqNullSafe(edge_value)
    heavy = on_edge & (edge_weight > 1)
    cut = cut.withColumns({
        "_range": F.when(F.col(score).isNull(), F.lit(-1 if descending else 2 * len(edges) + 4))
                   .otherwise(2 * slot + F.when(on_edge, 0).otherwise(1)),
        "_part": F.when(heavy, F.floor(F.col("_key_range") * (edge_weight + 1) / (len(key_edges) + 1)))
                  .when(F.col(score).isNull(), F.col("_key_range").cast("bigint")).otherwise(F.lit(0)).cast("bigint"),
    }).drop("_key_range")
    sizes = cut.groupBy("_range", "_part").agg(F.count(F.lit(1)).alias("_n"))
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    earlier = W.orderBy(range_order, F.col("_part")).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_range", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy("_range", "_part").orderBy(*order)
    # at most a few rows per range, and the number of ranges is fixed above
    return (cut.withColumn("_rn", F.row_number().over(within))
               .join(F.broadcast(offsets), ["_range", "_part"])
               .withColumn(out, (F.col("_rn") + F.col("_before")).cast("bigint"))
               .drop("_range", "_part", "_rn", "_before"))


def tiles(df: DataFrame, score: str, key: str, n: int = 10, descending: bool = True, out: str = "bucket",
          rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``ntile(n)`` over the whole table: the first ``rows % n`` tiles get one row more."""
    rows = df.count()
    placed = row_positions(df, score, key, descending, "_position", rows_per_range, rows)
    size, extra = divmod(rows, n)
    zero = F.col("_position") - 1
    tile = F.when(zero < extra * (size + 1), F.floor(zero / (size + 1)) + 1)
    tile = tile.otherwise(extra + F.floor((zero - extra * (size + 1)) / max(size, 1)) + 1)
    return placed.withColumn(out, tile.cast("bigint")).drop("_position")


def quantile_table(df: DataFrame, column: str, qs: Sequence[float], by: Sequence[str] = (), exact: bool = True,
                   accuracy: int = 10_000, direct_rows: int = DIRECT_VALUES, rows_per_range: int = ROWS_PER_RANGE,
                   max_groups: int = MAX_GROUPS) -> DataFrame:
    """Percentiles of ``column`` per group, as rows ``(by..., q, value)``; nulls are ignored.

    Exact ones interpolate linearly. Few distinct values go to the built-in aggregate, whose state is one count per
    value. With more, a sketch first tells between which two values each percentile lies; everything
    outside those brackets is merely counted. Very many groups are cut into value ranges instead.
    ``exact=False`` stops at the sketch.
    """
    by, qs = list(by), [float(q) for q in qs]
    df = df.select(*by, F.col(column).alias("_v")).where(F.col("_v").isNotNull())
    wanted = F.array(*[F.lit(q) for q in qs])
    if not exact:
        found = df.groupBy(*by).agg(F.percentile_approx("_v", wanted, accuracy).alias("_values"))
        return _spell_out(found, by, qs)
    sketch = _sketch(df, qs, by, max_groups, 10_000)
    if sketch is None:
        values = df.agg(F.approx_count_distinct(F.struct(*by, "_v"))).first()[0]
        return _ranged_quantiles(df, qs, by, values, rows_per_range)
    if sum(row["_values"] for row in sketch) <= direct_rows:
        found = df.groupBy(*by).agg(F.percentile("_v", wanted).alias("_values"))
        return _spell_out(found, by, qs)
    rows = sum(row["_rows"] for row in sketch)
    if rows > FINE_ROWS:
        accuracy = min(1_000_000, rows // 1_000_000)
        sketch = _sketch(df, qs, by, max_groups, accuracy)
    else:
        accuracy = 10_000
    found = _bracketed_quantiles(df, qs, by, sketch, accuracy)
    if found is None:
        return _ranged_quantiles(df, qs, by, sum(row["_values"] for row in sketch), rows_per_range)
    return found


def _sketch(df: DataFrame, qs: list[float], by: list[str], max_groups: int, accuracy: int) -> list | None:
    """Per group its size, about how many values it has, and brackets around each percentile; None if
    there are more than ``max_groups`` groups.
    """
    margin = 2.0 / accuracy
    ends = [min(1.0, max(0.0, q + side)) for q in qs for side in (-margin, margin)]
    found = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"), F.approx_count_distinct("_v").alias("_values"), F.min("_v").alias("_min"),
        F.max("_v").alias("_max"), F.percentile_approx("_v", ends, accuracy).alias("_ends"))
    rows = (found.limit(max_groups + 1) if by else found).collect()
    return None if len(rows) > max_groups else [r for r in rows if r["_rows"]]


def _bracketed_quantiles(df: DataFrame, qs: list[float], by: list[str], sketch: list, accuracy: int) -> DataFrame | None:
    """Exact percentiles of few groups from a sketch and one counting pass; None if a bracket misses its rank.

    The sketch errs by at most ``rows / accuracy`` ranks, so brackets twice as wide hold a share of
    about ``4 / accuracy`` of a group. Only their values reach the shuffle one by one.
    """
    margin = 2.0 / accuracy
    merged = []
    for row in sketch:
        pairs = [(row["_min"] if q <= margin else low, row["_max"] if q >= 1 - margin else high)
                 for q, low, high in zip(qs, row["_ends"][::2], row["_ends"][1::2])]
        lows, highs = [], []
        for low, high in sorted(pairs):
            if highs and low <= highs[-1]:
                highs[-1] = max(highs[-1], high)
            else:
                lows.append(low)
                highs.append(high)
        merged.append((*[row[k] for k in by], row["_rows"], lows, highs))
    kind = df.schema["_v"].dataType.simpleString()
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in by]
    if by:
        brackets = df.sparkSession.createDataFrame(
            merged, ", ".join([*keys, "_rows long", f"_lows array<{kind}>", f"_highs array<{kind}>"]))
        placed = null_safe_join(df, brackets, by, few=True)
    elif merged:
        rows, lows, highs = merged[0]
        placed = df.withColumns({"_rows": F.lit(rows).cast("long"), "_lows": F.lit(lows).cast(f"array<{kind}>"),
                                 "_highs": F.lit(highs).cast(f"array<{kind}>")})
    else:
        return None
    placed = placed.withColumn("_slot", F.size(F.filter("_highs", lambda h: h < F.col("_v"))))
    inside = F.col("_v") >= F.get("_lows", F.col("_slot"))
    cells = placed.groupBy(*by, "_rows", "_slot", F.when(inside, F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    # offsets of the slots, as many as percentiles; what a slot has outside its bracket comes before the bracket
    slots = cells.groupBy(*by, "_slot").agg(F.sum("_n").alias("_in_slot"), F.coalesce(
        F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("_outside"))
    earlier = W.partitionBy(*by).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = slots.select(*by, "_slot", (F.coalesce(F.sum("_in_slot").over(earlier), F.lit(0)) + F.col("_outside")).alias("_before"))
    within = W.partitionBy(*by, "_slot").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = cells.where(F.col("_v").isNotNull()).withColumn("_inside", F.sum("_n").over(within) - F.col("_n"))
    cells = null_safe_join(inner, offsets, [*by, "_slot"]).withColumn("_start", F.col("_inside") + F.col("_before"))
    found = _at_ranks(cells, qs, by).where("_reached").select(*by, "q", "value").collect()
    if len(found) < len(qs) * len(merged):
        return None
    return df.sparkSession.createDataFrame([tuple(r) for r in found], ", ".join([*keys, "q double", "value double"]))


def _at_ranks(cells: DataFrame, qs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Interpolated percentiles from value counts with their first rank ``_start``; ``_reached`` tells
    whether both ranks that matter were among the cells.
    """
    wanted = F.array(*[F.lit(q) for q in qs])
    low, high = F.floor(F.col("_at")), F.ceil(F.col("_at"))

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_n"))

    placed = cells.select("*", F.explode(wanted).alias("q")).withColumn("_at", F.col("q") * (F.col("_rows") - 1))
    ends = placed.where(holds(low) | holds(high)).groupBy(*by, "q", "_at").agg(
        F.min("_v").alias("_low"), F.max("_v").alias("_high"),
        (F.bool_or(holds(low)) & F.bool_or(holds(high))).alias("_reached"))
    share = F.col("_at") - F.floor(F.col("_at"))
    between = F.col("_low") * (1 - share) + F.col("_high") * share
    return ends.withColumn("value", F.when(F.col("_low") == F.col("_high"), F.col("_low").cast("double")).otherwise(between))


def _ranged_quantiles(df: DataFrame, qs: Sequence[float], by: Sequence[str], values: int, rows_per_range: int) -> DataFrame:
    """Exact percentiles of any number of groups: count per value range, then order the ranges that matter."""
    counted = materialise(df.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "counted")
    edges = sorted(set(percent_points(counted, "_v", _range_count(values, rows_per_range))))
    collapsed = into_ranges(counted, "_v", edges, "_range")
    per_range = collapsed.groupBy(*by, "_range").agg(F.sum("_n").alias("_size"))
    group = W.partitionBy(*by)
    upto = group.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = per_range.select(*by, "_range", (F.sum("_size").over(upto) - F.col("_size")).alias("_start"),
                             "_size", F.sum("_size").over(group).alias("_rows"))

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_size"))

    matters = F.lit(False)
    for q in qs:
        at = F.lit(q) * (F.col("_rows") - 1)
        matters = matters | holds(F.floor(at)) | holds(F.ceil(at))
    needed = spans.where(matters).select(*by, "_range", "_start", "_rows")
    within = W.partitionBy(*by, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = null_safe_join(collapsed, needed, [*by, "_range"])
    near = near.withColumn("_start", F.col("_start") + F.sum("_n").over(within) - F.col("_n"))
    return _at_ranks(near, qs, by).select(*by, "q", "value")


def _spell_out(found: DataFrame, by: Sequence[str], qs: Sequence[float]) -> DataFrame:
    pairs = F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), F.col("_values").alias("value"))
    return found.select(*by, F.explode(pairs).alias("_pair")).select(
        *by, F.col("_pair.q").alias("q"), F.col("_pair.value").cast("double").alias("value"))


def quantiles(df: DataFrame, column: str, qs: Sequence[float], **options: object) -> list[float]:
    """Percentiles of one whole column as plain numbers, for use as literals in later expressions."""
    found = {row["q"]: row["value"] for row in quantile_table(df, column, qs, **options).collect()}
    return [found.get(float(q)) for q in qs]


def quantiles_of(df: DataFrame, columns: Sequence[str], qs: Sequence[float], exact: bool = True,
                 direct_rows: int = DIRECT_VALUES) -> dict[str, list[float]]:
    """Percentiles of several columns; all columns with few distinct values share one pass."""
    if not exact:
        return {c: quantiles(df, c, qs, exact=False) for c in columns}
    distinct = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if distinct[c] <= direct_rows]
    found = {}
    if few:
        row = df.agg(*[F.percentile(c, F.array(*[F.lit(float(q)) for q in qs])).alias(c) for c in few]).first()
        found = {c: list(row[c]) if row[c] is not None else [None] * len(qs) for c in few}
    return {c: found[c] if c in found else quantiles(df, c, qs, direct_rows=direct_rows) for c in columns}
