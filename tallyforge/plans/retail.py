"""Retail star-schema questions: line items are the facts; parts, orders and customers with their nation and region
the dimensions. Facts are added up per foreign key before a dimension is joined, so a key with very many
facts reaches the join as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import aggregates, columns, joins, quality, reshape, windows
from tallyforge.plans.registry import Tables, query
from tallyforge.session import materialise, scratch_path
from tallyforge.sources import files

SQL_PROFIT = "(l_extendedprice * (0.3::DOUBLE - l_discount) - l_quantity * 200)"


def profit() -> Column:
    return F.col("l_extendedprice") * (F.lit(0.3) - F.col("l_discount")) - F.col("l_quantity") * 200


def customers_with_region(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.col("r_name").alias("region"))


@query("table_shape", """
SELECT 'orders' AS table_name, count(*)::BIGINT AS n_rows, 6::BIGINT AS n_columns FROM orders
UNION ALL SELECT 'lineitem', count(*)::BIGINT, 11::BIGINT FROM lineitem
UNION ALL SELECT 'customer', count(*)::BIGINT, 5::BIGINT FROM customer""")
def table_shape(t: Tables) -> DataFrame:
    return reshape.stack_tagged({n: columns.shape(getattr(t, n)) for n in ("orders", "lineitem", "customer")}, "table_name")


@query("total_and_average", """
SELECT round(sum(l_extendedprice), 2) AS total_sales, round(avg(l_extendedprice), 2) AS avg_sales FROM lineitem""")
def total_and_average(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(F.sum("l_extendedprice"), 2).alias("total_sales"),
                          F.round(F.avg("l_extendedprice"), 2).alias("avg_sales"))


@query("count_by_group", """
SELECT r_name AS region, count(c_custkey)::BIGINT AS n_rows FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY 2 DESC""")
def count_by_group(t: Tables) -> DataFrame:
    return aggregates.count_by(customers_with_region(t), ["region"]).orderBy(F.col("n_rows").desc(), "region")


@query("group_with_max_count", """
WITH c AS (SELECT r_name AS region, count(*)::BIGINT AS n_rows FROM customer JOIN nation ON c_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT region, n_rows FROM c WHERE n_rows = (SELECT max(n_rows) FROM c)""")
def group_with_max_count(t: Tables) -> DataFrame:
    return aggregates.extreme_groups(customers_with_region(t), ["region"], F.count(F.lit(1)), "n_rows")


@query("sum_by_group", """
SELECT l_partkey, sum(l_quantity) AS n_sold FROM lineitem GROUP BY 1 ORDER BY 2 DESC""")
def sum_by_group(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("n_sold")).orderBy(
        F.col("n_sold").desc(), "l_partkey")


@query("star_join_filtered", """
SELECT c_name, sum(l_quantity) AS n_bought FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND p_type = 'SMALL' GROUP BY 1""")
def star_join_filtered(t: Tables) -> DataFrame:
    # filters first: only lines of wanted parts are moved, and orders of buyers outside the region never meet them
    buyers = customers_with_region(t).where("region = 'ASIA'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    small = t.part.where("p_type = 'SMALL'").select(F.col("p_partkey").alias("l_partkey"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(small, "l_partkey", "left_semi")
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    bought = t.orders.select("o_orderkey", "o_custkey").join(buyers, "o_custkey")
    return bought.join(per_order, "o_orderkey").groupBy("c_name").agg(F.sum("q").alias("n_bought"))


@query("profit_by_category", f"""
SELECT p_type, round(sum({SQL_PROFIT}), 4) AS profit FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def profit_by_category(t: Tables) -> DataFrame:
    per_part = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(profit()).alias("profit"))
    return per_part.join(t.part.select("p_partkey", "p_type"), "p_partkey").groupBy("p_type").agg(
        F.round(F.sum("profit"), 4).alias("profit"))


@query("profit_by_category_and_sub", f"""
SELECT p_type, p_brand, round(sum({SQL_PROFIT}), 4) AS profit FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY ALL""")
def profit_by_category_and_sub(t: Tables) -> DataFrame:
    per_part = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(profit()).alias("profit"))
    return per_part.join(t.part.select("p_partkey", "p_type", "p_brand"), "p_partkey").groupBy("p_type", "p_brand").agg(
        F.round(F.sum("profit"), 4).alias("profit"))


@query("worst_category_drilldown", f"""
WITH f AS (SELECT p_brand, r_name AS region, {SQL_PROFIT} AS profit FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
worst AS (SELECT p_brand FROM f GROUP BY 1 ORDER BY sum(profit), 1 LIMIT 1)
SELECT p_brand, region, count(*)::BIGINT AS n_rows, round(sum(profit), 4) AS total FROM f
WHERE p_brand = (FROM worst) GROUP BY ALL""")
def worst_category_drilldown(t: Tables) -> DataFrame:
    brands = t.part.select("p_partkey", "p_brand")
    lines = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("o_orderkey"),
                              profit().alias("profit"))
    per_part = lines.groupBy("p_partkey").agg(F.sum("profit").alias("profit"))
    totals = per_part.join(brands, "p_partkey").groupBy("p_brand").agg(F.sum("profit").alias("total"))
    # the parts of the worst brand are chosen before any line is moved
    worst = F.broadcast(totals.orderBy("total", "p_brand").limit(1).select("p_brand"))  # one row
    branded = lines.join(materialise(brands.join(worst, "p_brand"), "worst-parts"), "p_partkey").drop("p_partkey")
    per_order = branded.groupBy("o_orderkey", "p_brand").agg(F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("n"))
    per_owner = per_order.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy(
        F.col("o_custkey").alias("c_custkey"), "p_brand").agg(F.sum("profit").alias("profit"), F.sum("n").alias("n"))
    placed = per_owner.join(customers_with_region(t).select("c_custkey", "region"), "c_custkey")
    return placed.groupBy("p_brand", "region").agg(F.sum("n").alias("n_rows"), F.round(F.sum("profit"), 4).alias("total"))


@query("merge_by_key", """
WITH o AS (SELECT o_custkey AS c_custkey, count(*)::BIGINT AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
d AS (SELECT o_custkey AS c_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1)
SELECT c_custkey, c_name, c_acctbal, n_orders, total, first_order
FROM (SELECT c_custkey, c_name FROM customer) JOIN (SELECT c_custkey, c_acctbal FROM customer) USING (c_custkey)
JOIN o USING (c_custkey) JOIN d USING (c_custkey)""")
def merge_by_key(t: Tables) -> DataFrame:
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return joins.merge_all([
        t.customer.select("c_custkey", "c_name"),
        t.customer.select("c_custkey", "c_acctbal"),
        orders.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")),
        orders.groupBy("c_custkey").agg(F.min("o_orderdate").alias("first_order")),
    ], "c_custkey")


@query("merge_conflict_count", """
WITH a AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer),
b AS (SELECT c_custkey, c_nationkey, greatest(c_acctbal, 0) AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)
SELECT column_name, n_conflict::BIGINT AS n_conflict FROM (
  SELECT count(*) FILTER (WHERE a.c_nationkey IS DISTINCT FROM b.c_nationkey) AS c_nationkey,
         count(*) FILTER (WHERE a.c_acctbal IS DISTINCT FROM b.c_acctbal) AS c_acctbal,
         count(*) FILTER (WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment) AS c_mktsegment
  FROM a JOIN b USING (c_custkey))
UNPIVOT (n_conflict FOR column_name IN (c_nationkey, c_acctbal, c_mktsegment))""")
def merge_conflict_count(t: Tables) -> DataFrame:
    one = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    two = t.customer.select("c_custkey", "c_nationkey", F.greatest("c_acctbal", F.lit(0.0)).alias("c_acctbal"),
                            F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return joins.merge_checked(one, two, "c_custkey")[1]


@query("missing_key_count", """
SELECT count(*)::BIGINT AS n_missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def missing_key_count(t: Tables) -> DataFrame:
    return quality.missing_keys(t.customer, t.orders, "c_custkey", "o_custkey").agg(F.count(F.lit(1)).alias("n_missing"))


@query("except_rows", """
SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def except_rows(t: Tables) -> DataFrame:
    bulk = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return reshape.setdiff(t.part.select("p_partkey", "p_name"), bulk, "p_partkey")


@query("map_values_counts", """
SELECT CASE p_type WHEN 'ECONOMY' THEN 'BASIC' WHEN 'STANDARD' THEN 'BASIC' WHEN 'PROMO' THEN 'SALE' ELSE p_type END AS p_type,
       count(*)::BIGINT AS n_rows FROM part GROUP BY 1""")
def map_values_counts(t: Tables) -> DataFrame:
    fixed = joins.map_values("p_type", {"ECONOMY": "BASIC", "STANDARD": "BASIC", "PROMO": "SALE"})
    return aggregates.count_by(t.part.select(fixed.alias("p_type")), ["p_type"])


@query("argmax_row", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")
def argmax_row(t: Tables) -> DataFrame:
    return aggregates.argmax(t.orders, "o_totalprice", "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("second_largest", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem WHERE l_quantity < (SELECT max(l_quantity) FROM lineitem))""")
def second_largest(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return aggregates.nth_largest(lines, "l_quantity", 2)


@query("argmax_per_column", """
WITH c AS (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS max_price, min(o_totalprice) AS min_price
           FROM orders GROUP BY 1)
SELECT 'n_orders' AS measure, (SELECT o_custkey FROM c ORDER BY n_orders DESC, o_custkey LIMIT 1) AS holder, max(n_orders)::DOUBLE AS max_value FROM c
UNION ALL SELECT 'max_price', (SELECT o_custkey FROM c ORDER BY max_price DESC, o_custkey LIMIT 1), max(max_price) FROM c
UNION ALL SELECT 'min_price', (SELECT o_custkey FROM c ORDER BY min_price DESC, o_custkey LIMIT 1), max(min_price) FROM c""")
def argmax_per_column(t: Tables) -> DataFrame:
    owners = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"),
                                               F.max("o_totalprice").alias("max_price"), F.min("o_totalprice").alias("min_price"))
    return aggregates.argmax_many(owners, ["n_orders", "max_price", "min_price"], "o_custkey", "o_custkey")


@query("sum_for_members", """
SELECT o_orderpriority AS member, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') GROUP BY 1""")
def sum_for_members(t: Tables) -> DataFrame:
    return aggregates.sum_where(t.orders, "o_orderpriority", ["1-URGENT", "3-MEDIUM", "5-LOW"], "o_totalprice")


@query("last_n_rows", """
SELECT o_orderdate, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def last_n_rows(t: Tables) -> DataFrame:
    return windows.last_n(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 10)


@query("onehot_to_label_join", """
SELECT p_type AS label, count(*)::BIGINT AS n_rows, round(sum(l_quantity), 2) AS quantity
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def onehot_to_label_join(t: Tables) -> DataFrame:
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    matrix = t.part.select("p_partkey", *[(F.col("p_type") == k).cast("int").alias(k) for k in kinds])
    per_part = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return joins.onehot_lookup(per_part, matrix, "p_partkey").groupBy("label").agg(
        F.sum("n").alias("n_rows"), F.round(F.sum("q"), 2).alias("quantity"))


@query("tolerant_cast", """
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER)::BIGINT AS rank_no,
TRY_CAST(o_orderpriority AS INTEGER)::BIGINT AS bad_number FROM orders""")
def tolerant_cast(t: Tables) -> DataFrame:
    texts = t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("rank_no"),
                            F.col("o_orderpriority").alias("bad_number"))
    return columns.cast_columns(texts, {"rank_no": "bigint", "bad_number": "bigint"})


@query("csv_roundtrip", """
SELECT p_type, count(*)::BIGINT AS n_rows, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1""")
def csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "part_csv")
    files.write_csv(t.part, path)
    stored = files.read_csv(t.spark, path, t.part.schema)
    return stored.groupBy("p_type").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("view_in_sql", """
SELECT o_orderstatus, count(*)::BIGINT AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_totalprice > 100000 GROUP BY 1""")
def view_in_sql(t: Tables) -> DataFrame:
    files.view(t.orders, "tallyforge_orders")
    return t.spark.sql("""SELECT o_orderstatus, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total
                          FROM tallyforge_orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus""")
