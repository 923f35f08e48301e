"""Investment ranking. Orders stand in for funding rounds: total price = amount, priority = round type; the
customer gives country (nation) and sector (market segment)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import bands
from tallyforge.operators import aggregates, windows
from tallyforge.plans.registry import Tables, query

LOW, HIGH = 100_000.0, 400_000.0
HOME = 7


def per_member(t: Tables, rounds: DataFrame) -> DataFrame:
    """Amount and number of rounds per country and sector; rounds are added up per owner before the lookup."""
    per_owner = rounds.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("amount"), F.count(F.lit(1)).alias("n"))
    owners = t.customer.select("c_custkey", F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("sector"))
    return per_owner.join(owners, "c_custkey").groupBy("country", "sector").agg(
        F.sum("amount").alias("amount"), F.sum("n").alias("n_rounds"))


@query("top_members_by_sum", """
SELECT c_nationkey AS country, round(sum(o_totalprice), 2) AS measure FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 9""")
def top_members_by_sum(t: Tables) -> DataFrame:
    top = windows.top_members(per_member(t, t.orders), "country", F.sum("amount"), 9)
    return top.select("country", F.round("measure", 2).alias("measure"))


@query("top3_sectors_in_top3_members", f"""
WITH f AS (SELECT c_nationkey AS country, c_mktsegment AS sector, o_totalprice, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
top AS (SELECT country FROM f WHERE country <> {HOME} GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 3),
c AS (SELECT country, sector, sum(o_totalprice) AS amount, count(*)::BIGINT AS n_rounds FROM f
  WHERE o_orderpriority = '2-HIGH' AND o_totalprice BETWEEN {LOW} AND {HIGH} AND country IN (FROM top) GROUP BY ALL)
SELECT country, sector, round(amount, 2) AS amount, n_rounds,
row_number() OVER (PARTITION BY country ORDER BY n_rounds DESC, sector)::BIGINT AS idx FROM c QUALIFY idx <= 3""")
def top3_sectors_in_top3_members(t: Tables) -> DataFrame:
    top = windows.top_members(per_member(t, t.orders), "country", F.sum("amount"), 3, exclude=[HOME])
    venture = t.orders.where((F.col("o_orderpriority") == "2-HIGH") & F.col("o_totalprice").between(LOW, HIGH))
    cells = per_member(t, venture).join(F.broadcast(top.select("country")), "country", "left_semi")
    ranked = windows.row_index_per(cells, ["country"], [F.col("n_rounds").desc(), F.col("sector")], 3)
    return ranked.select("country", "sector", F.round("amount", 2).alias("amount"), "n_rounds", "idx")


@query("sum_avg_share", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS sum_value, round(avg(o_totalprice), 4) AS avg_value,
round(100 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 4) AS pct FROM orders GROUP BY 1""")
def sum_avg_share(t: Tables) -> DataFrame:
    return aggregates.share_of_total(t.orders, "o_orderpriority", "o_totalprice")


@query("member_groups", """
SELECT CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW', '1-URGENT') THEN 'Others' ELSE o_orderpriority END AS round_type,
count(*)::BIGINT AS n_rows, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1""")
def member_groups(t: Tables) -> DataFrame:
    grouped = bands.member_group("o_orderpriority", {"Others": ["4-NOT SPECIFIED", "5-LOW", "1-URGENT"]})
    return t.orders.groupBy(grouped.alias("round_type")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
