"""Staff attendance and attrition preparation. A user's first and last event of a day stand in for arrival and
departure; customers for staff records."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import aggregates, charts, prep, ranking, reshape
from tallyforge.plans.registry import Tables, query

SQL_DAYS = """days AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(
  (SELECT min(ts)::DATE FROM events)::TIMESTAMP, (SELECT max(ts)::DATE FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS d)),
present AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, datesub('second', min(ts), max(ts)) / 3600::DOUBLE AS hours
  FROM events GROUP BY ALL),
long AS (SELECT user_id, day, hours FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN days LEFT JOIN present USING (user_id, day))"""


def calendar(events: DataFrame) -> list[str]:
    """Every day from the first to the last event."""
    first, last = events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    return [(first + timedelta(days=i)).isoformat() for i in range((last - first).days + 1)]


def hours_long(t: Tables) -> DataFrame:
    """Presence hours as rows ``(user_id, day, hours)`` from two wide tables of times; absent days are null."""
    days = calendar(t.events)
    day = F.date_format("ts", "yyyy-MM-dd")
    arrivals = reshape.wide_days(t.events.select("user_id", "ts"), "user_id", day, F.min("ts"), days)
    departures = reshape.wide_days(t.events.select("user_id", "ts"), "user_id", day, F.max("ts"), days)
    return reshape.interval_hours(arrivals, departures, "user_id", days)


def present_hours(t: Tables) -> DataFrame:
    """Hours of every day on which a user is present; days of absence have no row."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    spans = t.events.groupBy("user_id", day).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return spans.select("user_id", "day", (F.timestamp_diff("SECOND", F.col("first"), F.col("last")) / 3600.0).alias("hours"))


@query("daily_hours", f"WITH {SQL_DAYS} SELECT user_id, day, round(hours, 6) AS hours FROM long")
def daily_hours(t: Tables) -> DataFrame:
    return hours_long(t).select("user_id", "day", F.round("hours", 6).alias("hours"))


@query("hours_and_absences", f"""
WITH {SQL_DAYS} SELECT user_id, round(avg(hours), 8) AS mean_value, count(*) FILTER (WHERE hours IS NULL)::BIGINT AS n_missing,
(avg(hours) > 8)::INT AS over_time, (avg(hours) < 8)::INT AS short_time FROM long GROUP BY 1""")
def hours_and_absences(t: Tables) -> DataFrame:
    hours = present_hours(t)
    days = t.events.agg((F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))) + 1).alias("n")).scalar()
    return reshape.attendance_present(hours, "user_id", "hours", days, standard=8, digits=8)


@query("active_days", f"""
WITH {SQL_DAYS} SELECT day, count(hours)::BIGINT AS n_present FROM long GROUP BY 1 HAVING count(hours) > 0""")
def active_days(t: Tables) -> DataFrame:
    return reshape.active_days(present_hours(t), "day", "hours")


@query("impute_mode", """
WITH m AS (SELECT c_mktsegment FROM customer WHERE c_mktsegment <> 'FURNITURE' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN (FROM m) ELSE c_mktsegment END AS segment, count(*)::BIGINT AS n_rows
FROM customer GROUP BY 1""")
def impute_mode(t: Tables) -> DataFrame:
    gaps = t.customer.select(F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("segment"))
    return aggregates.count_by(prep.impute(gaps, {"segment": "mode"}), ["segment"])


@query("impute_median", """
WITH g AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer)
SELECT c_custkey, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM g)) AS balance FROM g""")
def impute_median(t: Tables) -> DataFrame:
    gaps = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return prep.impute(gaps, {"balance": "median"})


@query("median_by_group", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem GROUP BY 1""")
def median_by_group(t: Tables) -> DataFrame:
    table = ranking.quantile_table(t.lineitem, "l_extendedprice", [0.5], ["l_returnflag"])
    return table.select("l_returnflag", F.round("value", 4).alias("median"))


@query("zscore_stats", """
WITH z AS (SELECT l_returnflag, (l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_samp(l_extendedprice) FROM lineitem) AS price,
(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem) AS quantity FROM lineitem)
SELECT l_returnflag, round(min(price), 6) AS min_price, round(max(price), 6) AS max_price, round(avg(price), 6) AS avg_price,
round(avg(quantity), 6) AS avg_quantity FROM z GROUP BY 1""")
def zscore_stats(t: Tables) -> DataFrame:
    z = prep.zscore(t.lineitem.select("l_returnflag", "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"])
    return z.groupBy("l_returnflag").agg(
        F.round(F.min("l_extendedprice"), 6).alias("min_price"), F.round(F.max("l_extendedprice"), 6).alias("max_price"),
        F.round(F.avg("l_extendedprice"), 6).alias("avg_price"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"))


@query("dummy_counts", """
SELECT 'p_type_' || p_type AS dummy, count(*)::BIGINT AS n_rows FROM part
WHERE p_type <> (SELECT min(p_type) FROM part) GROUP BY 1""")
def dummy_counts(t: Tables) -> DataFrame:
    coded = prep.dummies(t.part.select("p_type"), ["p_type"])
    names = coded.columns
    return coded.agg(*[F.sum(f"`{n}`").alias(n) for n in names]).unpivot([], names, "dummy", "n_rows")


@query("binary_encode_counts", """
SELECT (l_linestatus = (SELECT max(l_linestatus) FROM lineitem))::INT AS l_linestatus, count(*)::BIGINT AS n_rows
FROM lineitem GROUP BY 1""")
def binary_encode_counts(t: Tables) -> DataFrame:
    return aggregates.count_by(prep.binary_encode(t.lineitem.select("l_linestatus"), "l_linestatus"), ["l_linestatus"])


@query("leavers_by_category", """
WITH l AS (SELECT c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer WHERE c_acctbal < 0)
SELECT 'c_mktsegment' AS column_name, c_mktsegment AS level, count(*)::BIGINT AS n_rows FROM l GROUP BY ALL
UNION ALL SELECT 'c_nationkey', c_nationkey, count(*)::BIGINT FROM l GROUP BY ALL""")
def leavers_by_category(t: Tables) -> DataFrame:
    return charts.bars_long(t.customer.where("c_acctbal < 0"), ["c_mktsegment", "c_nationkey"])
