"""Trip-record quality and trip statistics. A line item with its order date stands in for a trip: supplier = vendor,
order date = start, ship date = end, quantity = distance, tax = tip, line status = payment type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import bands, dates
from tallyforge.operators import aggregates, joins, quality, ranking
from tallyforge.plans.registry import Tables, query
from tallyforge.session import scratch_path
from tallyforge.sources import files

TRIP = {"vendor": "l_suppkey", "line": "l_linenumber", "distance": "l_quantity", "amount": "l_extendedprice",
        "extra": "l_discount", "tip": "l_tax", "payment": "l_linestatus", "rate_code": "l_returnflag",
        "end_at": "l_shipdate"}

EXTRAS = [0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09]


def wrong_rules() -> dict[str, Column]:
    """What makes a trip record faulty, by rule."""
    c = F.col
    return {
        "year": F.year("start_at") > 2000,
        "order": c("start_at") >= c("end_at"),
        "line": ~c("line").isin(1, 2, 3, 4, 5, 6),
        "rate_code": (c("line") == 1) & (c("rate_code") == "N"),
        "amount": c("amount") <= 1500,
        "extra": ~c("extra").isin(EXTRAS),
        "tip": (c("tip") < 0) | ((c("tip") > 0.07) & (c("payment") != "F")),
        "distance": c("distance") <= 0,
    }


def right_rules() -> dict[str, Column]:
    """The same rules from the other side: what a clean record fulfils."""
    c = F.col
    return {
        "year": F.year("start_at") <= 2000,
        "order": c("start_at") < c("end_at"),
        "line": c("line").isin(1, 2, 3, 4, 5, 6),
        "rate_code": (c("line") != 1) | (c("rate_code") != "N"),
        "amount": c("amount") > 1500,
        "extra": c("extra").isin(EXTRAS),
        "tip": (c("tip") >= 0) & ((c("tip") <= 0.07) | (c("payment") == "F")),
        "distance": c("distance") > 0,
    }


SQL_RULES = {
    "year": "year(start_at) > 2000",
    "order": "start_at >= end_at",
    "line": "line NOT IN (1, 2, 3, 4, 5, 6)",
    "rate_code": "(line = 1 AND rate_code = 'N')",
    "amount": "amount <= 1500",
    "extra": "extra > 0.095",
    "tip": "(tip < 0 OR (tip > 0.07 AND payment <> 'F'))",
    "distance": "distance <= 0",
}
SQL_TRIPS = """trips AS (SELECT l_suppkey AS vendor, l_linenumber AS line, l_quantity AS distance, l_extendedprice AS amount,
l_discount AS extra, l_tax AS tip, l_linestatus AS payment, l_returnflag AS rate_code, l_shipdate AS end_at,
o_orderdate AS start_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL_FAULT = "(" + " OR ".join(SQL_RULES.values()) + ")"
SQL_CLEAN = f"{SQL_TRIPS}, clean AS (SELECT * FROM trips WHERE NOT {SQL_FAULT})"
SQL_SPEED = "distance / (date_diff('second', start_at, end_at)::DOUBLE / 3600)"


def trips(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), *[F.col(c).alias(n) for n, c in TRIP.items()])
    starts = t.orders.select("o_orderkey", F.col("o_orderdate").alias("start_at"))
    return joins.lookup_join(lines, starts, "o_orderkey").drop("o_orderkey")


def clean_trips(t: Tables) -> DataFrame:
    return quality.keep_clean(trips(t), right_rules())


@query("fault_counts_by_group", f"""
WITH {SQL_TRIPS} SELECT vendor, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE {SQL_FAULT})::BIGINT AS faulty,
{', '.join(f'count(*) FILTER (WHERE {sql})::BIGINT AS faulty_{name}' for name, sql in SQL_RULES.items())} FROM trips GROUP BY 1""")
def fault_counts_by_group(t: Tables) -> DataFrame:
    return quality.fault_counts(trips(t), wrong_rules(), ["vendor"])


@query("fault_rate_by_group", f"""
WITH {SQL_TRIPS} SELECT vendor, count(*)::BIGINT AS n_rows,
round(100 * avg(CASE WHEN {SQL_FAULT} THEN 1.0::DOUBLE ELSE 0 END), 4) AS fault_pct FROM trips GROUP BY 1""")
def fault_rate_by_group(t: Tables) -> DataFrame:
    return quality.fault_rate(trips(t), wrong_rules(), ["vendor"])


@query("clean_row_count", f"WITH {SQL_CLEAN} SELECT count(*)::BIGINT AS n_rows FROM clean")
def clean_row_count(t: Tables) -> DataFrame:
    return clean_trips(t).agg(F.count(F.lit(1)).alias("n_rows"))


SQL_CROSS = {"ends_before_start": "end_at < start_at", "tip_without_card": "tip > 0 AND payment <> 'F'",
             "charged_for_line_7": "line = 7 AND amount > 0"}


@query("cross_field_violations", f"WITH {SQL_TRIPS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {sql})::BIGINT AS n_rows FROM trips" for n, sql in SQL_CROSS.items()))
def cross_field_violations(t: Tables) -> DataFrame:
    return quality.violations(trips(t), {
        "ends_before_start": F.col("end_at") < F.col("start_at"),
        "tip_without_card": (F.col("tip") > 0) & (F.col("payment") != "F"),
        "charged_for_line_7": (F.col("line") == 7) & (F.col("amount") > 0)})


DOMAIN = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("domain_min_max", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, "
    f"count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS n_null FROM lineitem" for c in DOMAIN))
def domain_min_max(t: Tables) -> DataFrame:
    return quality.domain_profile(t.lineitem, DOMAIN)


@query("value_counts", "SELECT l_discount, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return quality.value_counts(t.lineitem, "l_discount")


@query("partitioned_orc_roundtrip", f"""
WITH {SQL_CLEAN} SELECT month(start_at)::BIGINT AS mnth, payment, count(*)::BIGINT AS n_rows,
round(avg(amount), 2) AS avg_amount FROM clean WHERE month(start_at) IN (11, 12) GROUP BY ALL""")
def partitioned_orc_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "trips_orc")
    files.write_partitioned(clean_trips(t).withColumn("mnth", F.month("start_at")), path, ["mnth"])
    stored = files.read_columnar(t.spark, path, "orc").where(F.col("mnth").isin(11, 12))
    return stored.groupBy(F.col("mnth").cast("bigint").alias("mnth"), "payment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("amount"), 2).alias("avg_amount"))


@query("avg_by_group", f"""
WITH {SQL_CLEAN} SELECT month(start_at)::BIGINT AS mnth, round(avg(amount), 2) AS avg_amount FROM clean GROUP BY 1""")
def avg_by_group(t: Tables) -> DataFrame:
    return clean_trips(t).groupBy(F.month("start_at").cast("bigint").alias("mnth")).agg(
        F.round(F.avg("amount"), 2).alias("avg_amount"))


@query("share_by_group", """
WITH c AS (SELECT l_linenumber, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY 1)
SELECT l_linenumber, n_rows, round(100 * n_rows::DOUBLE / sum(n_rows) OVER (), 2) AS pct FROM c""")
def share_by_group(t: Tables) -> DataFrame:
    return aggregates.with_share(aggregates.count_by(t.lineitem, ["l_linenumber"]), "n_rows")


@query("bucket_share", """
WITH b AS (SELECT CASE WHEN l_quantity >= 1 AND l_quantity < 41 THEN 'ten ' || (1 + floor((l_quantity - 1) / 10))::INT
  ELSE 'beyond' END AS bucket FROM lineitem)
SELECT bucket, count(*)::BIGINT AS n_rows, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM b), 2) AS pct
FROM b GROUP BY 1""")
def bucket_share(t: Tables) -> DataFrame:
    labels = [f"ten {i}" for i in range(1, 5)]
    buckets = t.lineitem.select(bands.bucket("l_quantity", [1, 11, 21, 31, 41], labels, "beyond").alias("bucket"))
    return aggregates.with_share(aggregates.count_by(buckets, ["bucket"]), "n_rows")


@query("approx_percentiles", """
SELECT round(avg(l_extendedprice), 2) AS average, true AS p25, true AS p50, true AS p75 FROM lineitem""")
def approx_percentiles(t: Tables) -> DataFrame:
    """The average, and whether each approximate percentile is within the rank error that its accuracy promises."""
    qs = [0.25, 0.5, 0.75]
    found = t.lineitem.agg(F.percentile_approx("l_extendedprice", qs, 1000)).first()[0]
    price = F.col("l_extendedprice")

    def right(q: float, value: float) -> Column:
        below, upto = F.avg((price < value).cast("int")), F.avg((price <= value).cast("int"))
        return (below <= q + 0.001) & (upto >= q - 0.001)

    return t.lineitem.agg(F.round(F.avg(price), 2).alias("average"),
                          *[right(q, v).alias(n) for q, v, n in zip(qs, found, ("p25", "p50", "p75"))])


@query("exact_percentiles", " UNION ALL ".join(
    f"SELECT {q}::DOUBLE AS q, round(quantile_cont(l_extendedprice, {q}), 4) AS value FROM lineitem"
    for q in (0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)))
def exact_percentiles(t: Tables) -> DataFrame:
    table = ranking.quantile_table(t.lineitem, "l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0])
    return table.select("q", F.round("value", 4).alias("value"))


@query("conditional_averages", f"""
WITH {SQL_CLEAN} SELECT round(corr(line, tip), 4) AS correlation,
round(avg(CASE WHEN line = 1 THEN tip END), 4) AS solo_tip, round(avg(CASE WHEN line <> 1 THEN tip END), 4) AS group_tip
FROM clean""")
def conditional_averages(t: Tables) -> DataFrame:
    line = F.col("line")
    return clean_trips(t).agg(F.round(F.corr("line", "tip"), 4).alias("correlation"),
                              F.round(aggregates.avg_where("tip", line == 1), 4).alias("solo_tip"),
                              F.round(aggregates.avg_where("tip", line != 1), 4).alias("group_tip"))


@query("pair_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pair_correlation(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("avg_rate_per_hour", f"""
WITH {SQL_CLEAN} SELECT month(start_at)::BIGINT AS mnth, round(avg({SQL_SPEED}), 6) AS avg_speed FROM clean GROUP BY 1""")
def avg_rate_per_hour(t: Tables) -> DataFrame:
    speed = aggregates.avg_rate_per_hour(F.col("distance"), dates.elapsed_hours("start_at", "end_at"))
    return clean_trips(t).groupBy(F.month("start_at").cast("bigint").alias("mnth")).agg(F.round(speed, 6).alias("avg_speed"))


@query("avg_rate_on_days", f"""
WITH {SQL_CLEAN} SELECT day(start_at)::BIGINT AS dy, round(avg({SQL_SPEED}), 6) AS avg_speed FROM clean
WHERE month(start_at) = 12 AND day(start_at) IN (25, 31) GROUP BY 1""")
def avg_rate_on_days(t: Tables) -> DataFrame:
    speed = aggregates.avg_rate_per_hour(F.col("distance"), dates.elapsed_hours("start_at", "end_at"))
    feast = (F.month("start_at") == 12) & F.dayofmonth("start_at").isin(25, 31)
    return clean_trips(t).where(feast).groupBy(F.dayofmonth("start_at").cast("bigint").alias("dy")).agg(
        F.round(speed, 6).alias("avg_speed"))
