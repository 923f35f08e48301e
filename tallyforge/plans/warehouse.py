"""A small warehouse over orders: checked loading, stored summaries, bucketed facts, and spellings brought together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates
from tallyforge.operators import quality, similar, summaries
from tallyforge.plans.registry import Tables, query
from tallyforge.session import materialise, scratch_path
from tallyforge.sources import checked, files

# --- damaged lines ---------------------------------------------------------------------------------------------------

SQL_KINDS = """kinds AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 89 = 0 THEN 'quote' WHEN o_orderkey % 97 = 0 THEN 'fields'
WHEN o_orderkey % 101 = 0 THEN 'value' ELSE 'clean' END AS reason FROM orders)"""


@query("damaged_lines", f"""
WITH {SQL_KINDS} SELECT reason, count(*)::BIGINT AS n_rows, CASE WHEN reason = 'clean' THEN round(sum(o_totalprice), 2) END AS total
FROM kinds GROUP BY reason""")
def damaged_lines(t: Tables) -> DataFrame:
    """Orders as text with two title lines a file and injected damage, read back: every line is a row or a reject with its reason."""
    key = F.col("o_orderkey")
    good = F.concat_ws(",", key, F.concat(F.lit('"'), "o_orderpriority", F.lit(', ""'), "o_orderstatus", F.lit('"""')), F.format_string("%.2f", "o_totalprice"))
    line = F.when(key % 89 == 0, F.concat_ws(",", key, F.lit('"open'), F.lit("1.0"))).when(key % 97 == 0, F.concat_ws(",", key, "o_orderpriority"))
    line = line.when(key % 101 == 0, F.concat_ws(",", key, F.lit("x"), F.lit("twelve"))).otherwise(good)
    lines = t.orders.select(F.pmod(key, F.lit(4)).alias("part"), key.alias("place"), line.alias("value"))
    titles = t.spark.createDataFrame([(p, i, f"title, {i}, of, part, {p}") for p in range(4) for i in (-2, -1)], "part bigint, place bigint, value string")
    path = scratch_path(t.spark, "damaged")
    lines.unionByName(titles).repartition("part").sortWithinPartitions("part", "place").drop("place").write.partitionBy("part").text(path)
    rows, rejects = checked.read_checked(t.spark, f"{path}/*", "okey bigint, what string, price double", skip=2)
    clean = rows.agg(F.lit("clean").alias("reason"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("price"), 2).alias("total"))
    return clean.unionByName(rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(None).cast("double").alias("total")))


@query("numbers_that_are_none", """
SELECT (o_orderkey % 7 = 0)::INT AS odd, count(*) FILTER (o_orderkey % 7 = 0 AND o_orderkey % 2 = 0)::BIGINT AS n_damaged,
round(sum(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END), 2) AS total FROM orders GROUP BY 1""")
def numbers_that_are_none(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 7 != 0, F.concat(F.lit(" "), F.format_string("%.2f", "o_totalprice"))).when(key % 2 == 0, "n/a").otherwise("  ")
    number, damaged = checked.to_number(text)
    return t.orders.groupBy((key % 7 == 0).cast("int").alias("odd")).agg(F.count(F.when(damaged, 1)).alias("n_damaged"), F.round(F.sum(number), 2).alias("total"))


# --- summaries of parts, stored and merged ---------------------------------------------------------------------------

MONTHS = ("1996-03", "1998-08")
SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]
SQL_FISCAL = "(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END)::BIGINT"


def stored_months(t: Tables) -> DataFrame:
    """Summaries of every month of orders, written by month; read back, they are all that the queries below see."""
    month = t.orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).withColumn("fiscal_year", dates.fiscal_year("o_orderdate"))
    found = summaries.summarise(month, ["fiscal_year", "month"], ["o_totalprice"], ["o_custkey", "o_orderkey"], ["o_orderpriority"])
    path = scratch_path(t.spark, "summaries")
    files.write_partitioned(found, path, ["month"], "parquet", rebalance=False)
    return files.read_columnar(t.spark, path)


@query("stored_quantiles", f"""
SELECT unnest({SHARES})::DOUBLE AS share, n_rows, true AS within_bound FROM (SELECT count(*)::BIGINT AS n_rows FROM orders
WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '{MONTHS[0]}' AND '{MONTHS[1]}')""")
def stored_quantiles(t: Tables) -> DataFrame:
    """Quantiles over a range of months from their stored sketches, and whether their exact ranks are within the stated error."""
    chosen = stored_months(t).where(F.col("month").between(*MONTHS))
    merged = summaries.merge(summaries.merge(chosen, ["fiscal_year"]).select("n", "o_totalprice_quantiles"), [])
    asked = materialise(merged.select("n", F.inline(F.array(*[F.struct(F.lit(s).alias("share"), summaries.quantile("o_totalprice", s).alias("value"))
                                                             for s in SHARES]))), "asked")
    rows = t.orders.where(F.date_format("o_orderdate", "yyyy-MM").between(*MONTHS)).select("o_totalprice")
    values = {r["share"]: r["value"] for r in asked.collect()}
    below = rows.agg(*[F.avg((F.col("o_totalprice") <= v).cast("double")).alias(f"s{i}") for i, v in enumerate(values.values())])
    ranks = below.select(F.inline(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"s{i}").alias("rank")) for i, s in enumerate(values)])))
    error = F.abs(F.col("rank") - F.col("share"))
    return asked.join(ranks, "share").select("share", F.col("n").alias("n_rows"), (error <= 2 * summaries.RANK_ERROR).alias("within_bound"))


@query("stored_distinct", f"""
SELECT {SQL_FISCAL} AS fiscal_year, count(*)::BIGINT AS n_rows, count(DISTINCT o_custkey)::BIGINT AS n_customers, true AS within_bound FROM orders GROUP BY 1""")
def stored_distinct(t: Tables) -> DataFrame:
    """Customers per fiscal year from the sketches of its months, next to the exact number."""
    merged = summaries.merge(stored_months(t), ["fiscal_year"]).select("fiscal_year", F.col("n").alias("n_rows"), summaries.distinct_count("o_custkey").alias("about"))
    exact = t.orders.groupBy(dates.fiscal_year("o_orderdate").alias("fiscal_year")).agg(F.count_distinct("o_custkey").alias("n_customers"))
    off = F.abs(F.col("about") - F.col("n_customers")) / F.col("n_customers")
    return merged.join(exact, "fiscal_year").select("fiscal_year", "n_rows", "n_customers", (off <= summaries.DISTINCT_ERROR + 0.02).alias("within_bound"))


@query("stored_frequent", f"""
SELECT {SQL_FISCAL} AS fiscal_year, o_orderpriority AS item, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY fiscal_year ORDER BY count(*) DESC) <= 5""")
def stored_frequent(t: Tables) -> DataFrame:
    """The most frequent priorities per fiscal year from the sketches of its months; with fewer values than counters, counts are exact."""
    merged = summaries.merge(stored_months(t), ["fiscal_year"])
    return merged.select("fiscal_year", F.inline(summaries.frequent_values("o_orderpriority", 5))).select(
        "fiscal_year", "item", F.col("count").cast("bigint").alias("n_rows"))


# --- facts that lie where they are joined -----------------------------------------------------------------------------


@query("bucketed_join", """
SELECT o_orderpriority, count(*)::BIGINT AS n_lines, round(sum(l_quantity), 2) AS quantity, count(DISTINCT o_orderkey)::BIGINT AS n_orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def bucketed_join(t: Tables) -> DataFrame:
    """Lines and orders written in buckets of their common key; joined and counted per key without moving rows."""
    lines, orders = bucketed_facts(t.lineitem, t.orders)
    return by_priority(lines, orders)


def bucketed_facts(lines: DataFrame, orders: DataFrame, buckets: int = 8) -> tuple[DataFrame, DataFrame]:
    """Both tables in the catalogue under names of their own, data in the scratch folder."""
    made = []
    for df, key in ((lines.select(F.col("l_orderkey").alias("okey"), "l_quantity"), "lines"),
                    (orders.select(F.col("o_orderkey").alias("okey"), "o_orderpriority"), "orders")):
        name = f"facts_{key}_{uuid.uuid4().hex}"
        made.append(files.write_bucketed(df, name, "okey", buckets, scratch_path(df.sparkSession, name)))
    return made[0], made[1]


def by_priority(lines: DataFrame, orders: DataFrame) -> DataFrame:
    per_order = lines.groupBy("okey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    joined = per_order.join(orders.hint("merge"), "okey")
    return joined.groupBy("o_orderpriority").agg(F.sum("n").alias("n_lines"), F.round(F.sum("q"), 2).alias("quantity"), F.count(F.lit(1)).alias("n_orders"))


@query("bucketed_first_rows", """
SELECT count(*)::BIGINT AS n_orders, round(sum(l_quantity), 2) AS quantity FROM (SELECT l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) = 1)""")
def bucketed_first_rows(t: Tables) -> DataFrame:
    """One line per order, the largest, from lines in buckets of the order."""
    name = f"facts_lines_{uuid.uuid4().hex}"
    lines = files.write_bucketed(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), name, "l_orderkey", 8, scratch_path(t.spark, name))
    first = quality.dedupe(lines.withColumn("less", -F.col("l_quantity")), ["l_orderkey"], ["less", "l_linenumber"])
    return first.agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# --- spellings -------------------------------------------------------------------------------------------------------

SQL_SPELLED = """spelled AS (SELECT p_partkey, CASE p_partkey % 23 WHEN 0 THEN left(name, length(name) - 1) WHEN 1 THEN left(name, 3) || 'x' || substr(name, 4)
WHEN 2 THEN left(name, 4) || 'q' || substr(name, 6) ELSE name END AS name FROM (SELECT p_partkey, p_type || ' ' || p_name AS name FROM part))"""


def spelled(t: Tables) -> DataFrame:
    """Types and names of parts, every ninth with one letter lost, added or replaced."""
    name = F.concat_ws(" ", "p_type", "p_name")
    kind = F.col("p_partkey") % 23
    damaged = F.when(kind == 0, F.expr("left(name, length(name) - 1)")).when(kind == 1, F.expr("left(name, 3) || 'x' || substr(name, 4)")).when(
        kind == 2, F.expr("left(name, 4) || 'q' || substr(name, 6)"))
    return t.part.select("p_partkey", name.alias("name")).select("p_partkey", F.coalesce(damaged, "name").alias("name"))


@query("similar_names", f"""
WITH {SQL_SPELLED}, names AS (SELECT DISTINCT name FROM spelled)
SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name)::INT AS distance FROM names a JOIN names b ON a.name < b.name
AND levenshtein(a.name, b.name) <= 2""")
def similar_names(t: Tables) -> DataFrame:
    return similar.similar_pairs(spelled(t), "name", 2)


@query("spelling_map", f"""
WITH RECURSIVE {SQL_SPELLED}, names AS (SELECT name, count(*) AS n FROM spelled GROUP BY name),
best AS (SELECT a.name AS value, b.name AS mapped FROM names a JOIN names b ON a.name <> b.name AND levenshtein(a.name, b.name) <= 1 AND b.n >= 5 * a.n
  QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY b.n DESC, b.name) = 1),
walk AS (SELECT value, mapped, 0 AS step FROM best UNION ALL SELECT walk.value, best.mapped, step + 1 FROM walk JOIN best ON walk.mapped = best.value)
SELECT value, arg_max(mapped, step) AS mapped FROM walk GROUP BY value""")
def spelling_map(t: Tables) -> DataFrame:
    """Which spelling each rare one stands for, found and not typed in."""
    return similar.value_map(spelled(t), "name", 1, 5)
