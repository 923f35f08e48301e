"""Cab-request questions: demand, supply and the gap between them. Events stand in for requests: type = status
(``purchase`` = completed), value decides the pick-up point, user = driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates
from tallyforge.operators import aggregates, charts, prep, quality, reshape
from tallyforge.plans.registry import Tables, query

STATUSES = ["click", "error", "purchase", "signup", "view"]
SERVED = "purchase"
SQL_REQUESTS = """requests AS (SELECT event_id, ts AS request_at, event_type AS status,
CASE WHEN value >= 50 THEN 'Airport' ELSE 'City' END AS pickup,
CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE user_id END AS driver_id,
CASE WHEN event_type = 'purchase' THEN ts + to_seconds(floor(value * 60)::BIGINT) END AS drop_at, value FROM events)"""
SQL_SLOT = f"list_extract({list(dates.DAY_SLOTS)}, greatest((hour(request_at) + 3) // 4, 1))"


def requests(t: Tables) -> DataFrame:
    served = F.col("event_type") == SERVED
    return t.events.select(
        "event_id", F.col("ts").alias("request_at"), F.col("event_type").alias("status"),
        F.when(F.col("value") >= 50, "Airport").otherwise("City").alias("pickup"),
        F.when(~F.col("event_type").isin("error", "signup"), F.col("user_id")).alias("driver_id"),
        F.when(served, F.timestamp_add("SECOND", F.floor(F.col("value") * 60), F.col("ts"))).alias("drop_at"), "value")


def with_slot(t: Tables) -> DataFrame:
    return requests(t).withColumn("slot", dates.day_slot(F.hour("request_at")))


@query("null_by_label", f"""
WITH {SQL_REQUESTS} SELECT status, count(*)::BIGINT AS n_null FROM requests WHERE driver_id IS NULL GROUP BY 1""")
def null_by_label(t: Tables) -> DataFrame:
    return quality.null_by_label(requests(t), "driver_id", "status")


@query("uniqueness_profile", f"""
WITH {SQL_REQUESTS} SELECT 'event_id' AS column_name, count(DISTINCT event_id)::BIGINT AS n_distinct,
  (count(event_id) - count(DISTINCT event_id))::BIGINT AS n_duplicate FROM requests
UNION ALL SELECT 'driver_id', count(DISTINCT driver_id)::BIGINT, (count(driver_id) - count(DISTINCT driver_id))::BIGINT FROM requests
UNION ALL SELECT 'drop_at', count(DISTINCT drop_at)::BIGINT, (count(drop_at) - count(DISTINCT drop_at))::BIGINT FROM requests""")
def uniqueness_profile(t: Tables) -> DataFrame:
    return quality.uniqueness(requests(t), ["event_id", "driver_id", "drop_at"])


@query("distinct_values", f"WITH {SQL_REQUESTS} SELECT DISTINCT pickup, status FROM requests")
def distinct_values(t: Tables) -> DataFrame:
    return requests(t).select("pickup", "status").distinct()


@query("crosstab_counts", f"""
WITH {SQL_REQUESTS} SELECT pickup, status, {SQL_SLOT} AS slot, count(*)::BIGINT AS n_rows FROM requests GROUP BY ALL""")
def crosstab_counts(t: Tables) -> DataFrame:
    return aggregates.crosstab(with_slot(t), ["pickup", "status", "slot"])


@query("pivot_status_counts", f"""
WITH {SQL_REQUESTS} SELECT pickup, {SQL_SLOT} AS slot,
{', '.join(f"count(*) FILTER (WHERE status = '{s}')::BIGINT AS {s}" for s in STATUSES)} FROM requests GROUP BY ALL""")
def pivot_status_counts(t: Tables) -> DataFrame:
    return reshape.pivot_counts(with_slot(t), ["pickup", "slot"], "status", STATUSES)


@query("demand_supply_gap", f"""
WITH {SQL_REQUESTS} SELECT pickup, {SQL_SLOT} AS slot, count(*)::BIGINT AS demand,
count(*) FILTER (WHERE status = 'purchase')::BIGINT AS supply,
count(*) FILTER (WHERE status <> 'purchase')::BIGINT AS gap FROM requests GROUP BY ALL""")
def demand_supply_gap(t: Tables) -> DataFrame:
    return reshape.demand_supply_gap(with_slot(t), ["pickup", "slot"], "status", SERVED).orderBy(
        F.col("gap").desc(), "pickup", "slot")


@query("hourly_demand", f"""
WITH {SQL_REQUESTS} SELECT hour(request_at)::BIGINT AS hr, pickup, count(*)::BIGINT AS n_rows FROM requests GROUP BY ALL""")
def hourly_demand(t: Tables) -> DataFrame:
    return charts.bar_counts(requests(t).withColumn("hr", F.hour("request_at").cast("bigint")), "hr", "pickup")


@query("hourly_supply", f"""
WITH {SQL_REQUESTS} SELECT hour(drop_at)::BIGINT AS hr, pickup, count(*)::BIGINT AS n_rows FROM requests
WHERE drop_at IS NOT NULL GROUP BY ALL""")
def hourly_supply(t: Tables) -> DataFrame:
    done = requests(t).where(F.col("drop_at").isNotNull())
    return charts.bar_counts(done.withColumn("hr", F.hour("drop_at").cast("bigint")), "hr", "pickup")


@query("count_by_weekday", f"""
WITH {SQL_REQUESTS} SELECT strftime(request_at, '%a') AS weekday, pickup, count(*)::BIGINT AS n_rows FROM requests GROUP BY ALL""")
def count_by_weekday(t: Tables) -> DataFrame:
    return charts.bar_counts(requests(t).withColumn("weekday", dates.weekday_label("request_at")), "weekday", "pickup")


@query("elapsed_minutes", f"""
WITH {SQL_REQUESTS} SELECT event_id, round(date_diff('second', request_at, drop_at)::DOUBLE / 60) AS minutes FROM requests
WHERE status = 'purchase'""")
def elapsed_minutes(t: Tables) -> DataFrame:
    done = requests(t).where(F.col("status") == SERVED)
    return done.select("event_id", F.round(dates.elapsed_minutes("request_at", "drop_at"), 0).alias("minutes"))


@query("six_number_summary", """
WITH v AS (SELECT event_type, nullif(value, 0.05) AS value FROM events)
SELECT event_type, 'value' AS column_name, min(value) AS min_value, round(quantile_cont(value, 0.25), 4) AS q1,
round(quantile_cont(value, 0.5), 4) AS median, round(avg(value), 4) AS mean_value, round(quantile_cont(value, 0.75), 4) AS q3,
max(value) AS max_value, count(*) FILTER (WHERE value IS NULL)::BIGINT AS n_null FROM v GROUP BY 1""")
def six_number_summary(t: Tables) -> DataFrame:
    values = t.events.select("event_type", F.nullif("value", F.lit(0.05)).alias("value"))
    return aggregates.summary(values, ["value"], ["event_type"])


@query("boxplot_stats", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence FROM q)
SELECT event_type, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(low_fence, 4) AS low_fence,
round(high_fence, 4) AS high_fence, count(*) FILTER (WHERE value < low_fence OR value > high_fence)::BIGINT AS n_outlier
FROM f JOIN events USING (event_type) GROUP BY ALL""")
def boxplot_stats(t: Tables) -> DataFrame:
    return prep.boxplot_stats(t.events, "value", ["event_type"])


@query("multi_format_timestamp", """
SELECT event_id, date_trunc('second', ts) AS request_at FROM events""")
def multi_format_timestamp(t: Tables) -> DataFrame:
    dashed, slashed = F.date_format("ts", "dd-MM-yyyy HH:mm:ss"), F.date_format("ts", "d/M/yyyy HH:mm:ss")
    texts = t.events.select("event_id", F.when(F.col("event_type") == "click", slashed).otherwise(dashed).alias("text"))
    return texts.select("event_id", dates.parse_timestamp("text", ["dd-MM-yyyy HH:mm:ss", "d/M/yyyy HH:mm:ss"]).alias("request_at"))


@query("busiest_hour", """
SELECT hour(ts)::BIGINT AS hr, count(*)::BIGINT AS n_rows FROM events GROUP BY 1 ORDER BY n_rows DESC, hr LIMIT 1""")
def busiest_hour(t: Tables) -> DataFrame:
    hours = t.events.select(F.hour("ts").cast("bigint").alias("hr"))
    return aggregates.top_groups(hours, ["hr"], F.count(F.lit(1)), 1, "n_rows")


@query("split_datetime", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS request_date, strftime(ts, '%H:%M:%S') AS request_time,
hour(ts)::BIGINT AS request_hour FROM events""")
def split_datetime(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.to_date("ts").cast("string").alias("request_date"),
                           dates.time_text("ts").alias("request_time"), F.hour("ts").cast("bigint").alias("request_hour"))
