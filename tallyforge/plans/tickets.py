"""Parking-ticket questions. Orders stand in for tickets (priority = violation code, date = issue date, status =
vehicle type, customer's nation = registration state); events carry the time of day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates, text
from tallyforge.operators import aggregates, columns, quality, reshape, windows
from tallyforge.plans.registry import Tables, query

YEARS = (1996, 1997, 1998)
# The price of each code.
PRICES = [("1-URGENT", 115.0), ("2-HIGH", 55.0), ("3-MEDIUM", 50.0), ("4-NOT SPECIFIED", 45.0), ("5-LOW", 35.0)]


def by_state(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Tickets per state: counted per owner before the owner's state is looked up."""
    per_owner = (t.orders if orders is None else orders).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    owners = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return per_owner.join(owners, "o_custkey").groupBy("c_nationkey").agg(F.sum("n").alias("n_rows"))


def with_time_text(t: Tables) -> DataFrame:
    """Events with a 12-hour time text such as ``0953A``."""
    hour, two = F.hour("ts"), lambda c: F.lpad(c.cast("string"), 2, "0")
    half = F.when(hour < 12, "A").otherwise("P")
    return t.events.select("event_id", "event_type", F.concat(
        two((hour + 11) % 12 + 1), two(F.minute("ts")), half).alias("violation_time"))


SQL_BIN = f"list_extract({list(dates.TIME_BINS)}, h // 4 + 1)"
SQL_SEASON = f"list_extract({list(dates.SEASONS)}, m % 12 // 3 + 1)"
SQL_FY = "(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END)::BIGINT"


@query("top3_per_time_bin", f"""
WITH b AS (SELECT {SQL_BIN} AS time_bin, event_type FROM (SELECT hour(ts) AS h, event_type FROM events)),
c AS (SELECT time_bin, event_type, count(*)::BIGINT AS n_rows FROM b GROUP BY ALL),
r AS (SELECT *, dense_rank() OVER (PARTITION BY time_bin ORDER BY n_rows DESC)::BIGINT AS rnk FROM c)
SELECT time_bin, event_type, n_rows, rnk FROM r WHERE rnk <= 3""")
def top3_per_time_bin(t: Tables) -> DataFrame:
    binned = with_time_text(t).select(
        dates.time_bin(dates.hour_from_12h_text("violation_time")).alias("time_bin"), "event_type")
    return windows.top_k_per(binned, ["time_bin"], ["event_type"], 3)


@query("top3_per_season", f"""
WITH b AS (SELECT {SQL_SEASON} AS season, o_orderpriority FROM (SELECT month(o_orderdate) AS m, o_orderpriority FROM orders)),
c AS (SELECT season, o_orderpriority, count(*)::BIGINT AS n_rows FROM b GROUP BY ALL),
r AS (SELECT *, dense_rank() OVER (PARTITION BY season ORDER BY n_rows DESC)::BIGINT AS rnk FROM c)
SELECT season, o_orderpriority, n_rows, rnk FROM r WHERE rnk <= 3""")
def top3_per_season(t: Tables) -> DataFrame:
    seasons = t.orders.select(dates.season(F.month("o_orderdate")).alias("season"), "o_orderpriority")
    return windows.top_k_per(seasons, ["season"], ["o_orderpriority"], 3)


@query("count_by_season", f"""
SELECT {SQL_SEASON} AS season, count(*)::BIGINT AS n_rows FROM (SELECT month(o_orderdate) AS m FROM orders) GROUP BY 1""")
def count_by_season(t: Tables) -> DataFrame:
    return aggregates.count_by(t.orders.select(dates.season(F.month("o_orderdate")).alias("season")), ["season"])


@query("top_codes_by_time_bin", f"""
WITH b AS (SELECT {SQL_BIN} AS time_bin, event_type FROM (SELECT hour(ts) AS h, event_type FROM events)),
top AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
SELECT event_type, time_bin, count(*)::BIGINT AS n_rows FROM b WHERE event_type IN (FROM top) GROUP BY ALL""")
def top_codes_by_time_bin(t: Tables) -> DataFrame:
    binned = with_time_text(t).select(
        dates.time_bin(dates.hour_from_12h_text("violation_time")).alias("time_bin"), "event_type")
    cells = aggregates.count_by(binned, ["event_type", "time_bin"])
    # the cells answer both questions: which codes lead, and how they spread over the day
    top = windows.top_members(cells, "event_type", F.sum("n_rows"), 3)
    return cells.join(F.broadcast(top.select("event_type")), "event_type", "left_semi")


@query("fiscal_year_counts", f"""
SELECT {SQL_FY} AS fiscal_year, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1""")
def fiscal_year_counts(t: Tables) -> DataFrame:
    return aggregates.count_by(t.orders.select(dates.fiscal_year("o_orderdate").alias("fiscal_year")), ["fiscal_year"])


@query("fiscal_year_slice", """
SELECT o_orderstatus, count(*)::BIGINT AS n_rows FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-10-01' GROUP BY 1""")
def fiscal_year_slice(t: Tables) -> DataFrame:
    return aggregates.count_by(t.orders.where(dates.in_fiscal_year("o_orderdate", 1997)), ["o_orderstatus"])


@query("union_all_slices", """
SELECT o_orderstatus, count(*)::BIGINT AS n_rows, count(DISTINCT o_orderkey)::BIGINT AS n_keys FROM (
  SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-10-01' AND o_orderdate < TIMESTAMP '1996-10-01'
  UNION ALL SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-10-01'
  UNION ALL SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-10-01')
GROUP BY 1""")
def union_all_slices(t: Tables) -> DataFrame:
    slices = [t.orders.where(dates.in_fiscal_year("o_orderdate", y)).select("o_orderkey", "o_orderstatus") for y in YEARS]
    stacked = reshape.stack(*slices)
    per_key = stacked.groupBy("o_orderstatus", "o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("o_orderstatus").agg(F.sum("n").alias("n_rows"), F.count("o_orderkey").alias("n_keys"))


@query("in_list_counts", """
SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n_rows FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P') GROUP BY ALL""")
def in_list_counts(t: Tables) -> DataFrame:
    kept = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P"))
    return aggregates.count_by(kept, ["o_orderpriority", "o_orderstatus"])


@query("null_split_counts", """
SELECT l_returnflag, count(*) FILTER (WHERE nullif(l_discount, 0) IS NULL)::BIGINT AS n_null,
       count(nullif(l_discount, 0))::BIGINT AS n_present FROM lineitem GROUP BY 1""")
def null_split_counts(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_returnflag", F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return lines.groupBy("l_returnflag").agg(
        F.count(F.when(F.col("d").isNull(), 1)).alias("n_null"), F.count("d").alias("n_present"))


@query("dedupe_by_key", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1""")
def dedupe_by_key(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return quality.dedupe(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("count_by_year_month", """
SELECT year(o_orderdate)::BIGINT AS yr, month(o_orderdate)::BIGINT AS mnth, count(*)::BIGINT AS n_rows
FROM orders GROUP BY ALL""")
def count_by_year_month(t: Tables) -> DataFrame:
    parts = t.orders.select(F.year("o_orderdate").cast("bigint").alias("yr"),
                            F.month("o_orderdate").cast("bigint").alias("mnth"))
    return aggregates.count_by(parts, ["yr", "mnth"])


@query("date_parts", """
SELECT year(ts)::BIGINT AS yr, month(ts)::BIGINT AS mnth, day(ts)::BIGINT AS dy, hour(ts)::BIGINT AS hr,
       count(*)::BIGINT AS n_rows FROM events GROUP BY ALL""")
def date_parts(t: Tables) -> DataFrame:
    parts = {"yr": F.year("ts"), "mnth": F.month("ts"), "dy": F.dayofmonth("ts"), "hr": F.hour("ts")}
    return aggregates.count_by(t.events.select(*[c.cast("bigint").alias(n) for n, c in parts.items()]), list(parts))


@query("count_distinct", """
SELECT year(o_orderdate)::BIGINT AS yr, count(DISTINCT o_custkey)::BIGINT AS n_distinct FROM orders GROUP BY 1""")
def count_distinct(t: Tables) -> DataFrame:
    owners = t.orders.select(F.year("o_orderdate").cast("bigint").alias("yr"), "o_custkey")
    return aggregates.count_distinct_by(owners, "o_custkey", ["yr"])


SPARSE = {"quantity": ("l_quantity", 1.0), "discount": ("l_discount", 0.0), "tax": ("l_tax", 0.0)}


def sparse_lines(t: Tables) -> DataFrame:
    """Line items with nulls put where a measure has its lowest value."""
    return t.lineitem.select("l_returnflag", *[F.nullif(c, F.lit(v)).alias(n) for n, (c, v) in SPARSE.items()])


SQL_SPARSE = """(SELECT l_returnflag, nullif(l_quantity, 1) AS quantity, nullif(l_discount, 0) AS discount,
nullif(l_tax, 0) AS tax FROM lineitem)"""


@query("null_profile", f"""
SELECT 'quantity' AS column_name, (count(*) - count(quantity))::BIGINT AS n_null FROM {SQL_SPARSE}
UNION ALL SELECT 'discount', (count(*) - count(discount))::BIGINT FROM {SQL_SPARSE}
UNION ALL SELECT 'tax', (count(*) - count(tax))::BIGINT FROM {SQL_SPARSE}""")
def null_profile(t: Tables) -> DataFrame:
    return quality.null_profile(sparse_lines(t), list(SPARSE))


@query("unpivot_null_counts", f"""
WITH w AS (SELECT l_returnflag, count(*) - count(quantity) AS quantity, count(*) - count(discount) AS discount,
count(*) - count(tax) AS tax FROM {SQL_SPARSE} GROUP BY 1)
SELECT l_returnflag, column_name, n_null::BIGINT AS n_null FROM w
UNPIVOT (n_null FOR column_name IN (quantity, discount, tax))""")
def unpivot_null_counts(t: Tables) -> DataFrame:
    wide = sparse_lines(t).groupBy("l_returnflag").agg(
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in SPARSE])
    return reshape.unpivot(wide, ["l_returnflag"], list(SPARSE), "column_name", "n_null")


@query("drop_all_null_columns", """
SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS code FROM orders""")
def drop_all_null_columns(t: Tables) -> DataFrame:
    with_holes = t.orders.select(
        "o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("code"),
        F.nullif("o_orderkey", "o_orderkey").alias("latitude"), F.nullif("o_orderstatus", "o_orderstatus").alias("tract"))
    return columns.drop_all_null(with_holes)


@query("top_k_groups", """
SELECT c_nationkey, count(*)::BIGINT AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY 1 ORDER BY n_rows DESC, c_nationkey LIMIT 5""")
def top_k_groups(t: Tables) -> DataFrame:
    return by_state(t).orderBy(F.col("n_rows").desc(), "c_nationkey").limit(5)


@query("codes_of_top_states", """
WITH top AS (SELECT c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
             ORDER BY count(*) DESC, 1 LIMIT 3)
SELECT c_nationkey, o_orderpriority, count(*)::BIGINT AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_nationkey IN (FROM top) GROUP BY ALL""")
def codes_of_top_states(t: Tables) -> DataFrame:
    per_owner = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    owners = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    cells = per_owner.join(owners, "o_custkey").groupBy("c_nationkey", "o_orderpriority").agg(F.sum("n").alias("n_rows"))
    top = windows.top_members(cells, "c_nationkey", F.sum("n_rows"), 3)
    return cells.join(F.broadcast(top.select("c_nationkey")), "c_nationkey", "left_semi")


@query("top_k_per_year", f"""
WITH c AS (SELECT {SQL_FY} AS fiscal_year, o_orderpriority, count(*)::BIGINT AS n_rows FROM orders GROUP BY ALL)
SELECT fiscal_year, o_orderpriority, n_rows,
       row_number() OVER (PARTITION BY fiscal_year ORDER BY n_rows DESC, o_orderpriority)::BIGINT AS idx FROM c
QUALIFY idx <= 3""")
def top_k_per_year(t: Tables) -> DataFrame:
    years = t.orders.select(dates.fiscal_year("o_orderdate").alias("fiscal_year"), "o_orderpriority")
    counts = aggregates.count_by(years, ["fiscal_year", "o_orderpriority"])
    return windows.row_index_per(counts, ["fiscal_year"], [F.col("n_rows").desc(), F.col("o_orderpriority")], 3)


@query("stacked_yearly_tops", "\nUNION ALL ".join(
    f"(SELECT o_orderpriority, count(*)::BIGINT AS n_rows, {y}::BIGINT AS fiscal_year FROM orders "
    f"WHERE o_orderdate >= TIMESTAMP '{y - 1}-10-01' AND o_orderdate < TIMESTAMP '{y}-10-01' "
    "GROUP BY 1 ORDER BY n_rows DESC, o_orderpriority LIMIT 2)" for y in YEARS))
def stacked_yearly_tops(t: Tables) -> DataFrame:
    def top(year: int) -> DataFrame:
        counts = aggregates.count_by(t.orders.where(dates.in_fiscal_year("o_orderdate", year)), ["o_orderpriority"])
        return counts.orderBy(F.col("n_rows").desc(), "o_orderpriority").limit(2)

    stacked = reshape.stack_tagged({y: top(y) for y in YEARS}, "fiscal_year")
    return stacked.withColumn("fiscal_year", F.col("fiscal_year").cast("bigint"))


@query("hour_from_12h_text", """
SELECT hour(ts)::BIGINT AS hr, count(*)::BIGINT AS n_rows FROM events GROUP BY 1""")
def hour_from_12h_text(t: Tables) -> DataFrame:
    hours = with_time_text(t).select(dates.hour_from_12h_text("violation_time").alias("hr"))
    return aggregates.count_by(hours, ["hr"])


@query("mode_value", """
SELECT o_orderpriority, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1 ORDER BY n_rows DESC, 1 LIMIT 1""")
def mode_value(t: Tables) -> DataFrame:
    return aggregates.mode_of(t.orders, "o_orderpriority")


@query("replace_code_with_mode", """
WITH m AS (SELECT o_orderpriority FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'
           GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN (FROM m) ELSE o_orderpriority END AS code,
       count(*)::BIGINT AS n_rows FROM orders GROUP BY 1""")
def replace_code_with_mode(t: Tables) -> DataFrame:
    unknown = "4-NOT SPECIFIED"
    known = t.orders.where(F.col("o_orderpriority") != unknown)
    mode = aggregates.mode_of(known, "o_orderpriority").select("o_orderpriority").scalar()
    code = F.when(F.col("o_orderpriority") == unknown, mode).otherwise(F.col("o_orderpriority"))
    return aggregates.count_by(t.orders.select(code.alias("code")), ["code"])


@query("priced_top_k", f"""
WITH p(o_orderpriority, price) AS (VALUES {', '.join(f"('{c}', {v}::DOUBLE)" for c, v in PRICES)}),
a AS (SELECT {SQL_FY} AS fiscal_year, o_orderpriority, count(*)::BIGINT AS n_rows FROM orders GROUP BY ALL),
c AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY fiscal_year ORDER BY n_rows DESC, o_orderpriority) <= 3)
SELECT fiscal_year, o_orderpriority, n_rows, price, n_rows * price AS amount FROM c JOIN p USING (o_orderpriority)""")
def priced_top_k(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame(PRICES, "o_orderpriority string, price double")
    years = t.orders.select(dates.fiscal_year("o_orderdate").alias("fiscal_year"), "o_orderpriority")
    return windows.priced_top_k(years, "o_orderpriority", prices, 3, ["fiscal_year"])


@query("string_normalise", """
SELECT p_partkey, lower(replace(regexp_replace(trim('  ' || p_name || ' ' || p_brand || '? '), '\\s', '_', 'g'), '?', ''))
       AS name FROM part""")
def string_normalise(t: Tables) -> DataFrame:
    messy = F.concat(F.lit("  "), "p_name", F.lit(" "), "p_brand", F.lit("? "))
    return t.part.select("p_partkey", text.normalise(messy).alias("name"))
