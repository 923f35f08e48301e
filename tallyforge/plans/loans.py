"""Loan-default exploration. Orders stand in for loans: total price = amount, status ``F`` = charged off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import bands, dates, text
from tallyforge.operators import aggregates, charts, columns, ranking
from tallyforge.plans.registry import Tables, query

BANDS = ("q1", "q2", "q3", "q4")
SQL_BANDED = """q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2,
quantile_cont(o_totalprice, 0.75) AS q3 FROM orders),
banded AS (SELECT *, 'q' || (1 + (o_totalprice > q1)::INT + (o_totalprice > q2)::INT + (o_totalprice > q3)::INT) AS band FROM orders, q)"""


def defaulted() -> Column:
    return F.col("o_orderstatus") == "F"


def banded(t: Tables) -> DataFrame:
    quartiles = ranking.quantiles(t.orders, "o_totalprice", [0.25, 0.5, 0.75])
    return t.orders.withColumn("band", bands.quartile_band("o_totalprice", *quartiles, labels=BANDS))


@query("parse_number", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN p_size::DOUBLE WHEN 'LARGE' THEN p_size + 0.5::DOUBLE
WHEN 'SMALL' THEN 1::DOUBLE WHEN 'PROMO' THEN NULL ELSE p_size::DOUBLE END AS number FROM part""")
def parse_number(t: Tables) -> DataFrame:
    kind, size = F.col("p_type"), F.col("p_size").cast("string")
    written = (F.when(kind == "ECONOMY", F.concat(size, F.lit(" months"))).when(kind == "LARGE", F.concat(size, F.lit(".5%")))
               .when(kind == "SMALL", F.lit("< 1 year")).when(kind == "PROMO", F.lit("n/a"))
               .otherwise(F.concat(size, F.lit("+ years"))))
    return t.part.select("p_partkey", text.parse_number(written).alias("number"))


@query("issue_year_counts", "SELECT year(o_orderdate)::BIGINT AS yr, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1")
def issue_year_counts(t: Tables) -> DataFrame:
    written = t.orders.select(F.date_format("o_orderdate", "MMM-yy").alias("issue"))
    return aggregates.count_by(written.select(F.year(dates.parse_month_year("issue")).cast("bigint").alias("yr")), ["yr"])


@query("keep_by_null_share", "SELECT o_orderkey, nullif(o_custkey, 0) AS owner, o_totalprice FROM orders")
def keep_by_null_share(t: Tables) -> DataFrame:
    with_holes = t.orders.select(
        "o_orderkey", F.nullif("o_custkey", F.lit(0)).alias("owner"), "o_totalprice",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("code"), F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return columns.keep_by_null_share(with_holes, 0.05)


@query("event_rate_by_group", """
SELECT o_orderpriority, count(*)::BIGINT AS n_rows, sum((o_orderstatus = 'F')::INT)::BIGINT AS n_events,
round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM orders GROUP BY 1""")
def event_rate_by_group(t: Tables) -> DataFrame:
    return aggregates.rate_by(t.orders, defaulted(), ["o_orderpriority"])


@query("band_default_rate", f"""
WITH {SQL_BANDED} SELECT band, count(*)::BIGINT AS n_rows, sum((o_orderstatus = 'F')::INT)::BIGINT AS n_events,
round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM banded GROUP BY 1""")
def band_default_rate(t: Tables) -> DataFrame:
    return aggregates.rate_by(banded(t), defaulted(), ["band"])


@query("share_by_band_and_outcome", f"""
WITH {SQL_BANDED} SELECT band, o_orderstatus, count(*)::BIGINT AS n_rows,
round(100 * count(*)::DOUBLE / (SELECT count(*) FROM orders), 4) AS pct FROM banded GROUP BY ALL""")
def share_by_band_and_outcome(t: Tables) -> DataFrame:
    return charts.bar_share(banded(t), "band", "o_orderstatus")


@query("histogram", """
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT least(30, floor(30::DOUBLE * (l_extendedprice - lo) / (hi - lo)) + 1)::BIGINT AS bin, count(*)::BIGINT AS n_rows
FROM lineitem, r GROUP BY 1""")
def histogram(t: Tables) -> DataFrame:
    return charts.histogram(t.lineitem, "l_extendedprice", 30)
