"""Reading and tidying: delimited, headerless and external files, awkward headers, texts that are dates or times, and options
of rates and rankings. Tables are written out whole in the shape in question and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates
from tallyforge.operators import aggregates, columns, prep, windows
from tallyforge.plans.registry import Tables, query
from tallyforge.session import scratch_path
from tallyforge.sources import files

SQL_STATUS = """SELECT o_orderstatus, count(*)::BIGINT AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"""
ORDER_TYPES = {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double"}


def status_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("delimited_roundtrip", SQL_STATUS)
def delimited_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "orders_delimited")
    t.orders.select(*ORDER_TYPES).write.option("header", True).option("sep", "|").csv(path)
    schema = ", ".join(f"{n} {k}" for n, k in ORDER_TYPES.items())
    return status_totals(files.read_delimited(t.spark, path, schema, sep="|"))


@query("headerless_roundtrip", SQL_STATUS)
def headerless_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "orders_headerless")
    files.write_csv(t.orders.select(*ORDER_TYPES), path, header=False)
    return status_totals(files.read_headerless(t.spark, path, list(ORDER_TYPES), ORDER_TYPES))


@query("quoted_header_roundtrip", """
SELECT o_orderstatus AS "order status", round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def quoted_header_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "orders_quoted")
    files.write_csv(t.orders.select(F.col("o_orderstatus").alias("order status"), F.col("o_totalprice").alias("price, total")), path)
    stored = files.read_csv(t.spark, path)
    return stored.groupBy("order status").agg(F.round(F.sum(F.col("`price, total`").cast("double")), 2).alias("total"))


@query("external_table", """
SELECT month(o_orderdate)::INTEGER AS mnth, count(*)::BIGINT AS n_rows FROM orders WHERE month(o_orderdate) IN (3, 4) GROUP BY 1""")
def external_table(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "orders_external")
    files.write_partitioned(t.orders.select("o_orderkey", F.month("o_orderdate").alias("mnth")), path, ["mnth"], "parquet")
    stored = files.register_external(t.spark, "tallyforge_external_orders", path, "o_orderkey bigint, mnth int", "parquet", ["mnth"])
    return stored.where(F.col("mnth").isin(3, 4)).groupBy("mnth").agg(F.count(F.lit(1)).alias("n_rows"))


@query("normalised_names", "SELECT o_orderkey AS order_key, o_orderstatus AS is_done, o_totalprice AS price FROM orders")
def normalised_names(t: Tables) -> DataFrame:
    awkward = t.orders.select(F.col("o_orderkey").alias(" Order Key "), F.col("o_orderstatus").alias("Is Done?"),
                              F.col("o_totalprice").alias("PRICE"), F.col("o_custkey").alias("spare"))
    return columns.drop(columns.normalise_columns(awkward), ["spare"])


@query("renamed_and_bound", """
SELECT o_orderkey, o_totalprice AS price, n_lines FROM orders
JOIN (SELECT l_orderkey AS o_orderkey, count(*)::BIGINT AS n_lines FROM lineitem GROUP BY 1) USING (o_orderkey)""")
def renamed_and_bound(t: Tables) -> DataFrame:
    left = columns.rename(t.orders.select("o_orderkey", "o_totalprice"), {"o_totalprice": "price"})
    right = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return columns.bind_columns(left, right, "o_orderkey")


@query("text_dates", """
SELECT year(o_orderdate)::BIGINT AS yr, month(o_orderdate)::BIGINT AS mnth, count(*)::BIGINT AS n_rows FROM orders GROUP BY ALL""")
def text_dates(t: Tables) -> DataFrame:
    day = dates.parse_date(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return t.orders.groupBy(F.year(day).cast("bigint").alias("yr"), F.month(day).cast("bigint").alias("mnth")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("impute_constant", """
SELECT coalesce(nullif(o_orderstatus, 'F'), 'none') AS status, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1""")
def impute_constant(t: Tables) -> DataFrame:
    gaps = t.orders.select(F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return aggregates.count_by(prep.impute(gaps, {"status": "none"}), ["status"])


SQL_WEEK = "(SELECT min(ts)::DATE FROM events)"


@query("wide_text_times", f"""
WITH spans AS (SELECT user_id, datediff('day', {SQL_WEEK}, ts::DATE) AS nr, datesub('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) / 3600::DOUBLE AS h
  FROM events GROUP BY ALL)
SELECT user_id, count(*)::BIGINT AS n_present, round(avg(h), 6) AS mean_hours FROM spans WHERE nr BETWEEN 0 AND 6 GROUP BY 1""")
def wide_text_times(t: Tables) -> DataFrame:
    """Arrival and departure as texts in a column per day of one week, spelled out and parsed."""
    first = t.events.agg(F.min(F.to_date("ts"))).scalar()
    numbered = t.events.select("user_id", "ts", F.datediff(F.to_date("ts"), first).alias("nr")).where(F.col("nr").between(0, 6))
    week, text = [str(i) for i in range(7)], "yyyy-MM-dd HH:mm:ss"
    wide = [numbered.groupBy("user_id").pivot("nr", list(range(7))).agg(F.date_format(pick("ts"), text)) for pick in (F.min, F.max)]
    long = [w.unpivot("user_id", week, "nr", name).where(f"{name} IS NOT NULL") for w, name in zip(wide, ("arrival", "departure"))]
    both = columns.bind_columns(*long, ["user_id", "nr"])
    hours = dates.elapsed_hours(*[dates.parse_timestamp(c, [text]) for c in ("arrival", "departure")])
    return both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_present"), F.round(F.avg(hours), 6).alias("mean_hours"))


@query("rate_without_open", """
SELECT o_orderpriority, count(*)::BIGINT AS n_rows, sum((o_orderstatus = 'F')::INT)::BIGINT AS n_events,
round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def rate_without_open(t: Tables) -> DataFrame:
    decided = t.orders.where(F.col("o_orderstatus") != "P")
    return aggregates.rate_by(decided, F.col("o_orderstatus") == "F", ["o_orderpriority"])


@query("distinct_drilldown", """
WITH w AS (SELECT p_type FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY sum(l_extendedprice), 1 LIMIT 1)
SELECT p_brand, count(DISTINCT l_orderkey)::BIGINT AS n_orders FROM part JOIN lineitem ON l_partkey = p_partkey
WHERE p_type = (FROM w) GROUP BY 1""")
def distinct_drilldown(t: Tables) -> DataFrame:
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("price"))
    kinds = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    worst = per_part.join(kinds, "l_partkey").groupBy("p_type").agg(F.sum("price").alias("total")).orderBy("total", "p_type").first()
    chosen = kinds.where(F.col("p_type") == F.lit(worst["p_type"] if worst else None))
    pairs = t.lineitem.select("l_partkey", "l_orderkey").join(chosen, "l_partkey").select("p_brand", "l_orderkey").distinct()
    return pairs.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_orders"))


@query("top_members_after_filter", """
SELECT p_brand, sum(p_retailprice) AS measure FROM part WHERE p_size >= 10 AND p_brand <> 'Brand#11'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def top_members_after_filter(t: Tables) -> DataFrame:
    return windows.top_members(t.part.where("p_size >= 10"), "p_brand", F.sum("p_retailprice"), 3, exclude=["Brand#11"])


@query("members_by_other_measure", """
WITH m AS (SELECT c_mktsegment, sum(o_totalprice) AS total, count(*)::BIGINT AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_mktsegment, n_orders, row_number() OVER (ORDER BY total DESC, c_mktsegment)::BIGINT AS place FROM m""")
def members_by_other_measure(t: Tables) -> DataFrame:
    """Orders per segment, in order of another measure; as many rows as there are segments."""
    per_owner = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))
    sums = per_owner.join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey").groupBy("c_mktsegment").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n_orders"))
    placed = windows.row_index_per(sums, [], [F.col("total").desc(), F.col("c_mktsegment").asc()], 1 << 30, "place")
    return placed.select("c_mktsegment", "n_orders", "place").orderBy("place")
