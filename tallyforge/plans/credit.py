"""Credit scoring from raw applications to profit. Customers with a summary of their orders stand in for
applicants; a negative balance is the bad outcome, and a fixed formula gives a score to evaluate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import bands
from tallyforge.operators import aggregates, charts, evaluate, models, prep, quality, ranking, sampling, windows, woe
from tallyforge.operators.neighbours import nearest_rows
from tallyforge.operators.smote import smote
from tallyforge.plans.registry import Tables, query
from tallyforge.session import materialise

SQL_BASE = """base AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, (c_acctbal < 0)::INT AS bad,
coalesce(n_orders, 0) AS n_orders, avg_total, max_total,
least(0.99::DOUBLE, greatest(0.01::DOUBLE, (12000::DOUBLE - c_acctbal - 150 * coalesce(n_orders, 0)) / 14000)) AS p_bad
FROM customer LEFT JOIN (SELECT o_custkey, count(*)::BIGINT AS n_orders, round(avg(o_totalprice), 2) AS avg_total,
max(o_totalprice) AS max_total FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
BINS = 5


def applicants(t: Tables) -> DataFrame:
    """One row per customer; orders are summed up per owner first, so the join is one row to one row."""
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.avg("o_totalprice"), 2).alias("avg_total"),
        F.max("o_totalprice").alias("max_total"))
    base = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").join(orders, "c_custkey", "left")
    base = base.withColumns({"n_orders": F.coalesce("n_orders", F.lit(0)), "bad": (F.col("c_acctbal") < 0).cast("int")})
    raw = (F.lit(12000.0) - F.col("c_acctbal") - 150 * F.col("n_orders")) / 14000
    return base.withColumn("p_bad", F.least(F.lit(0.99), F.greatest(F.lit(0.01), raw)))


# --- missing values and outliers -----------------------------------------------------------------------------------

SQL_GAPS = """gaps AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS segment,
CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END AS name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer)"""


def with_gaps(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))


@query("blank_profile", f"""
WITH {SQL_GAPS} SELECT 'segment' AS column_name, count(*) FILTER (WHERE segment = '')::BIGINT AS n_blank,
round(100 * (count(*) FILTER (WHERE segment = ''))::DOUBLE / count(*), 4) AS blank_pct FROM gaps
UNION ALL SELECT 'name', count(*) FILTER (WHERE name = '')::BIGINT,
round(100 * (count(*) FILTER (WHERE name = ''))::DOUBLE / count(*), 4) FROM gaps""")
def blank_profile(t: Tables) -> DataFrame:
    return quality.blank_profile(with_gaps(t), ["segment", "name"])


@query("complete_case_count", f"""
WITH {SQL_GAPS} SELECT count(*)::BIGINT AS n_rows FROM gaps WHERE segment <> '' AND name <> '' AND balance IS NOT NULL""")
def complete_case_count(t: Tables) -> DataFrame:
    return quality.complete_cases(with_gaps(t)).agg(F.count(F.lit(1)).alias("n_rows"))


@query("correlation_long", f"""
WITH {SQL_BASE}, c AS (SELECT * FROM base WHERE avg_total IS NOT NULL)
SELECT 'c_acctbal' AS x, 'n_orders' AS y, round(corr(c_acctbal, n_orders), 6) AS r FROM c
UNION ALL SELECT 'c_acctbal', 'avg_total', round(corr(c_acctbal, avg_total), 6) FROM c
UNION ALL SELECT 'c_acctbal', 'max_total', round(corr(c_acctbal, max_total), 6) FROM c
UNION ALL SELECT 'n_orders', 'avg_total', round(corr(n_orders, avg_total), 6) FROM c
UNION ALL SELECT 'n_orders', 'max_total', round(corr(n_orders, max_total), 6) FROM c
UNION ALL SELECT 'avg_total', 'max_total', round(corr(avg_total, max_total), 6) FROM c""")
def correlation_long(t: Tables) -> DataFrame:
    return aggregates.corr_long(applicants(t), ["c_acctbal", "n_orders", "avg_total", "max_total"])


@query("clamped_stats", """
WITH c AS (SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 9000 THEN 9000 ELSE c_acctbal END AS b FROM customer)
SELECT min(b)::DOUBLE AS min_value, max(b)::DOUBLE AS max_value, round(avg(b), 4) AS avg_value FROM c""")
def clamped_stats(t: Tables) -> DataFrame:
    limited = prep.clamp(t.customer.select("c_acctbal"), {"c_acctbal": (0.0, 9000.0)})
    return limited.agg(F.min("c_acctbal").alias("min_value"), F.max("c_acctbal").alias("max_value"),
                       F.round(F.avg("c_acctbal"), 4).alias("avg_value"))


@query("clamped_by_percentile", """
WITH p AS (SELECT quantile_cont(o_totalprice, 0.02) AS lo, quantile_cont(o_totalprice, 0.98) AS hi FROM orders),
c AS (SELECT least(greatest(o_totalprice, lo), hi) AS b FROM orders, p)
SELECT round(min(b), 4) AS min_value, round(max(b), 4) AS max_value, round(avg(b), 4) AS avg_value FROM c""")
def clamped_by_percentile(t: Tables) -> DataFrame:
    limited = prep.clamp_at_percentiles(t.orders.select("o_totalprice"), "o_totalprice", 0.02, 0.98)
    return limited.agg(F.round(F.min("o_totalprice"), 4).alias("min_value"), F.round(F.max("o_totalprice"), 4).alias("max_value"),
                       F.round(F.avg("o_totalprice"), 4).alias("avg_value"))


BREAKS = [0, 1000, 2500, 5000, 9000]


@query("cut_right_closed", "SELECT CASE " + " ".join(
    f"WHEN c_acctbal > {a} AND c_acctbal <= {b} THEN '({a},{b}]'" for a, b in zip(BREAKS, BREAKS[1:]))
    + " END AS band, count(*)::BIGINT AS n_rows FROM customer GROUP BY 1")
def cut_right_closed(t: Tables) -> DataFrame:
    return aggregates.count_by(t.customer.select(bands.cut("c_acctbal", BREAKS).alias("band")), ["band"])


@query("cut_round_breaks", """
SELECT CASE WHEN o_totalprice <= 100000 THEN '(0,100000]' WHEN o_totalprice <= 200000 THEN '(100000,200000]'
WHEN o_totalprice <= 300000 THEN '(200000,300000]' WHEN o_totalprice <= 400000 THEN '(300000,400000]'
WHEN o_totalprice <= 500000 THEN '(400000,500000]' END AS band, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1""")
def cut_round_breaks(t: Tables) -> DataFrame:
    low, high = t.orders.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    band = bands.cut("o_totalprice", bands.round_breaks(low, high))
    return aggregates.count_by(t.orders.select(band.alias("band")), ["band"])


@query("quantile_bin_counts", """
WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS inner_edges FROM lineitem)
SELECT (1 + len(list_filter(inner_edges, lambda x: x < l_extendedprice)))::BIGINT AS bin, count(*)::BIGINT AS n_rows,
max(l_extendedprice) AS max_value FROM lineitem, e GROUP BY 1""")
def quantile_bin_counts(t: Tables) -> DataFrame:
    binned = prep.quantile_bins(t.lineitem.select("l_extendedprice"), "l_extendedprice", 10)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"), F.max("l_extendedprice").alias("max_value"))


@query("stacked_share", f"""
WITH {SQL_BASE}, c AS (SELECT c_mktsegment, bad, count(*)::BIGINT AS n_rows FROM base GROUP BY ALL)
SELECT *, round(100 * n_rows::DOUBLE / sum(n_rows) OVER (PARTITION BY c_mktsegment), 4) AS pct FROM c""")
def stacked_share(t: Tables) -> DataFrame:
    return charts.stack_share(t.customer.withColumn("bad", (F.col("c_acctbal") < 0).cast("int")), "c_mktsegment", "bad")


# --- weight of evidence --------------------------------------------------------------------------------------------

_EDGES = ", ".join(str(i / BINS) for i in range(1, BINS))


def _sql_bin(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'NA' ELSE (1 + len(list_filter(e_{c}, lambda x: x < {c} AND x > low_{c})))::VARCHAR END"


SQL_WOE = f"""{SQL_BASE}, edges AS (SELECT list_distinct(quantile_cont(n_orders, [{_EDGES}])) AS e_n_orders, min(n_orders) AS low_n_orders,
list_distinct(quantile_cont(avg_total, [{_EDGES}])) AS e_avg_total, min(avg_total) AS low_avg_total FROM base),
long AS (
SELECT c_custkey, bad, 'n_orders' AS variable, {_sql_bin('n_orders')} AS bin FROM base, edges
UNION ALL SELECT c_custkey, bad, 'avg_total', {_sql_bin('avg_total')} FROM base, edges
UNION ALL SELECT c_custkey, bad, 'c_mktsegment', c_mktsegment FROM base
UNION ALL SELECT c_custkey, bad, 'c_nationkey', c_nationkey::VARCHAR FROM base),
counts AS (SELECT variable, bin, count(*)::BIGINT AS n_rows, sum(bad)::BIGINT AS n_events,
  CASE WHEN sum(bad) = 0 OR sum(bad) = count(*) THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS bump FROM long GROUP BY ALL),
shares AS (SELECT *, (n_events + bump) / (SELECT sum(bad)::DOUBLE FROM base) AS pe,
  (n_rows - n_events + bump) / (SELECT sum(1 - bad)::DOUBLE FROM base) AS po FROM counts),
woe AS (SELECT variable, bin, n_rows, n_events, round(pe, 6) AS pct_events, round(po, 6) AS pct_others,
  round(ln(pe / po), 6) AS woe, round((pe - po) * ln(pe / po), 6) AS iv FROM shares)"""


def woe_parts(t: Tables) -> tuple[DataFrame, dict[str, Column], DataFrame]:
    base = materialise(applicants(t), "applicants")
    bins = woe.bin_columns(base, ["n_orders", "avg_total"], ["c_mktsegment", "c_nationkey"], BINS, numbered=True)
    return base, bins, woe.woe_table(base, bins, F.col("bad"))


@query("woe_table", f"WITH {SQL_WOE} SELECT * FROM woe")
def woe_table(t: Tables) -> DataFrame:
    return woe_parts(t)[2]


@query("iv_ranking", f"""
WITH {SQL_WOE} SELECT variable, round(sum(iv), 5) AS iv, round(sum(iv), 5) BETWEEN 0.1 AND 0.5 AS selected FROM woe GROUP BY 1""")
def iv_ranking(t: Tables) -> DataFrame:
    return woe.iv_ranking(woe_parts(t)[2]).orderBy(F.col("iv").desc(), "variable")


@query("woe_transform", f"""
WITH {SQL_WOE} SELECT c_custkey, max(woe) FILTER (WHERE variable = 'n_orders') AS n_orders_woe,
max(woe) FILTER (WHERE variable = 'avg_total') AS avg_total_woe,
max(woe) FILTER (WHERE variable = 'c_mktsegment') AS c_mktsegment_woe,
max(woe) FILTER (WHERE variable = 'c_nationkey') AS c_nationkey_woe
FROM long JOIN woe USING (variable, bin) GROUP BY 1""")
def woe_transform(t: Tables) -> DataFrame:
    base, bins, table = woe_parts(t)
    return woe.woe_transform(base, table, bins).select("c_custkey", *[f"{v}_woe" for v in bins])


# --- splits and samples --------------------------------------------------------------------------------------------

def _sql_hash(key: str, seed: int) -> str:
    return f"left(md5({key}::VARCHAR || ':{seed}'), 8)"


@query("hash_split_counts", f"""
SELECT CASE WHEN {_sql_hash('o_orderkey', 7)} < '{sampling.share_of_hashes(0.7)}' THEN 'train' ELSE 'test' END AS part,
count(*)::BIGINT AS n_rows, round(avg(o_totalprice), 2) AS avg_price FROM orders GROUP BY 1""")
def hash_split_counts(t: Tables) -> DataFrame:
    return sampling.split(t.orders, "o_orderkey", 0.7, 7).groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))


@query("stratified_split_counts", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_sql_hash('o_orderkey', 7)}, o_orderkey) AS rn,
count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, CASE WHEN rn <= floor(0.7::DOUBLE * n + 1e-9::DOUBLE) THEN 'train' ELSE 'test' END AS part,
count(*)::BIGINT AS n_rows, round(avg(o_totalprice), 2) AS avg_price FROM r GROUP BY ALL""")
def stratified_split_counts(t: Tables) -> DataFrame:
    parts = sampling.stratified_split(t.orders, "o_orderkey", "o_orderpriority", 0.7, 7)
    return parts.groupBy("o_orderpriority", "part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))


@query("sample_n", f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_sql_hash('o_orderkey', 11)}, o_orderkey LIMIT 1000""")
def sample_n(t: Tables) -> DataFrame:
    return sampling.sample_n(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 11)


@query("smote_class_counts", """
WITH n AS (SELECT count(*) FILTER (WHERE c_acctbal < 0) AS bad FROM customer)
SELECT 1 AS bad, (11 * bad)::BIGINT AS n_rows FROM n UNION ALL SELECT 0, (20 * bad)::BIGINT FROM n""")
def smote_class_counts(t: Tables) -> DataFrame:
    # customers without orders have no average, so they take part with zeros
    features = materialise(applicants(t).fillna(0.0, ["avg_total", "max_total"]), "applicants")
    balanced = smote(features, "bad", "c_custkey", ["n_orders", "avg_total", "max_total"], ["c_mktsegment"],
                     over=1000, under=200, k=5, seed=1, minority=1)
    return aggregates.count_by(balanced, ["bad"])


SQL_RARE = f"""{SQL_BASE}, rare AS (SELECT c_custkey, c_mktsegment, c_nationkey, n_orders::DOUBLE AS a, coalesce(avg_total, 0)::DOUBLE AS b,
coalesce(max_total, 0)::DOUBLE AS c, c_acctbal::DOUBLE AS d FROM base WHERE bad = 1),
scaled AS (SELECT c_custkey, c_mktsegment, c_nationkey, {", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in "abcd")} FROM rare)"""


@query("rare_neighbours", f"""
WITH {SQL_RARE}, pairs AS (SELECT x.c_custkey, y.c_custkey AS neighbour, {" + ".join(f"(x.{c} - y.{c}) ** 2" for c in "abcd")}
+ (x.c_mktsegment <> y.c_mktsegment)::INT + (x.c_nationkey <> y.c_nationkey)::INT AS d2 FROM scaled x JOIN scaled y ON x.c_custkey <> y.c_custkey)
SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, neighbour) AS place, round(d2, 9) AS d2 FROM pairs
QUALIFY place <= 5""")
def rare_neighbours(t: Tables) -> DataFrame:
    """The five nearest neighbours of every row of the rare class, over four numbers and two categories, in blocks of 64 rows."""
    rows = materialise(applicants(t).fillna(0.0, ["avg_total", "max_total"]).where("bad = 1"), "rare")
    names = ["n_orders", "avg_total", "max_total", "c_acctbal"]
    ends = rows.agg(*[f(c).cast("double").alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = [(F.col(c).cast("double") - ends[f"lo_{c}"]) / ((ends[f"hi_{c}"] - ends[f"lo_{c}"]) or 1.0) for c in names] if rows.count() else [
        F.lit(0.0) for _ in names]
    points = rows.select(F.col("c_custkey").cast("bigint").alias("vid"), F.lit(1).cast("bigint").alias("mult"), F.array(*scaled).alias("num"),
                         F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("cat"))
    found = nearest_rows(points, 4, 2, 5, 64)
    return found.select(F.col("vid").alias("c_custkey"), F.col("place").cast("bigint").alias("place"), F.round("d2", 9).alias("d2"))


# --- evaluation ----------------------------------------------------------------------------------------------------

CUT = 0.5
SQL_CURVE = f"""{SQL_BASE}, s AS (SELECT p_bad, sum(bad) AS pos, sum(1 - bad) AS neg FROM base GROUP BY 1),
curve AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg FROM s
  WINDOW w AS (ORDER BY p_bad DESC ROWS UNBOUNDED PRECEDING))"""
SQL_SWEEP = f"""{SQL_BASE}, grid AS (SELECT i::DOUBLE / 100 AS cutoff FROM range(1, 100) r(i)),
sweep AS (SELECT cutoff, round(sum((p_bad >= cutoff AND bad = 1)::INT)::DOUBLE / sum(bad), 6) AS sensitivity,
round(sum((p_bad < cutoff AND bad = 0)::INT)::DOUBLE / sum(1 - bad), 6) AS specificity,
round(sum(((p_bad >= cutoff) = (bad = 1))::INT)::DOUBLE / count(*), 6) AS accuracy FROM base, grid GROUP BY 1)"""


def scored(t: Tables) -> DataFrame:
    return applicants(t).select("c_custkey", "bad", "p_bad").withColumn(
        "pred", (F.col("p_bad") >= CUT).cast("int"))


@query("confusion_metrics", f"""
WITH {SQL_BASE}, c AS (SELECT count(*) FILTER (WHERE bad = 1 AND p_bad >= 0.5)::BIGINT AS tp,
count(*) FILTER (WHERE bad = 0 AND p_bad >= 0.5)::BIGINT AS fp, count(*) FILTER (WHERE bad = 1 AND p_bad < 0.5)::BIGINT AS fn,
count(*) FILTER (WHERE bad = 0 AND p_bad < 0.5)::BIGINT AS tn FROM base)
SELECT *, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(tp::DOUBLE / (tp + fn), 6) AS sensitivity,
round(tn::DOUBLE / (tn + fp), 6) AS specificity FROM c""")
def confusion_metrics(t: Tables) -> DataFrame:
    return evaluate.confusion(scored(t), "bad", "pred", 1)


@query("threshold_sweep", f"WITH {SQL_SWEEP} SELECT * FROM sweep")
def threshold_sweep(t: Tables) -> DataFrame:
    return evaluate.threshold_sweep(scored(t), "bad", "p_bad", [i / 100 for i in range(1, 100)])


@query("best_cutoff", f"""
WITH {SQL_SWEEP} SELECT * FROM sweep ORDER BY round(abs(sensitivity - specificity), 9), cutoff LIMIT 1""")
def best_cutoff(t: Tables) -> DataFrame:
    return evaluate.best_cutoff(evaluate.threshold_sweep(scored(t), "bad", "p_bad", [i / 100 for i in range(1, 100)]))


@query("ks_statistic", f"""
WITH {SQL_CURVE} SELECT round(max(cum_pos::DOUBLE / (SELECT sum(bad) FROM base) - cum_neg::DOUBLE / (SELECT sum(1 - bad) FROM base)), 6) AS ks
FROM curve""")
def ks_statistic(t: Tables) -> DataFrame:
    return evaluate.ks(scored(t), "bad", "p_bad")


@query("ks_on_class", f"""
WITH {SQL_BASE} SELECT round(count(*) FILTER (WHERE bad = 1 AND p_bad >= 0.5)::DOUBLE / sum(bad)
- count(*) FILTER (WHERE bad = 0 AND p_bad >= 0.5)::DOUBLE / sum(1 - bad), 6) AS ks FROM base""")
def ks_on_class(t: Tables) -> DataFrame:
    return evaluate.ks(scored(t).withColumn("class", evaluate.on_class("p_bad", CUT)), "bad", "class")


@query("roc_auc", f"""
WITH {SQL_BASE}
SELECT round((sum(rk) FILTER (WHERE bad = 1) - sum(bad)::DOUBLE * (sum(bad) + 1) / 2) / (sum(bad)::DOUBLE * sum(1 - bad)), 6) AS auc
FROM (SELECT bad, avg(rn) OVER (PARTITION BY p_bad) AS rk FROM (SELECT bad, p_bad, row_number() OVER (ORDER BY p_bad) AS rn FROM base))""")
def roc_auc(t: Tables) -> DataFrame:
    return evaluate.auc(scored(t), "bad", "p_bad")


@query("gain_lift", f"""
WITH {SQL_BASE}, tiled AS (SELECT bad, ntile(10) OVER (ORDER BY p_bad DESC, c_custkey)::BIGINT AS tile FROM base)
SELECT t.tile, count(*) FILTER (b.tile = t.tile)::BIGINT AS rows_in, sum(bad) FILTER (b.tile = t.tile)::BIGINT AS events_in,
round(sum(bad)::DOUBLE / (SELECT sum(bad) FROM tiled), 4) AS captured,
round(avg(bad) / (SELECT avg(bad) FROM tiled), 4) AS lift
FROM (SELECT DISTINCT tile FROM tiled) t JOIN tiled b ON b.tile <= t.tile GROUP BY t.tile""")
def gain_lift(t: Tables) -> DataFrame:
    return evaluate.gain_lift(scored(t), "bad", "p_bad", "c_custkey", 10)


SQL_TILES = """tiled AS (SELECT o_totalprice, ntile(10) OVER (ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS bucket FROM orders),
d AS (SELECT bucket, count(*)::BIGINT AS n_rows, min(o_totalprice) AS low, max(o_totalprice) AS high FROM tiled GROUP BY 1)"""


def order_tiles(t: Tables) -> DataFrame:
    tiled = ranking.tiles(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10)
    return tiled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_totalprice").alias("low"),
                                       F.max("o_totalprice").alias("high"))


@query("score_deciles", f"WITH {SQL_TILES} SELECT * FROM d")
def score_deciles(t: Tables) -> DataFrame:
    return order_tiles(t)


@query("running_total", f"""
WITH {SQL_TILES} SELECT bucket, n_rows, (sum(n_rows) OVER (ORDER BY bucket))::BIGINT AS cum_rows FROM d""")
def running_total(t: Tables) -> DataFrame:
    return windows.cumulative(order_tiles(t).select("bucket", "n_rows"), "bucket", "n_rows", "cum_rows")


# --- score card and profit -----------------------------------------------------------------------------------------

SQL_SCORE = f"""{SQL_BASE}, points AS (SELECT c_custkey, bad, p_bad,
400 - 20 / ln(2) * ln(10) + 20 / ln(2) * ln((1 - p_bad) / p_bad) AS score FROM base)"""
SQL_CUT = "(400 - 20 / ln(2) * ln(10) + 20 / ln(2) * ln((1 - 0.575::DOUBLE) / 0.575))"
POINTS_CUT = evaluate.points_at(0.575)


@query("scorecard_points", f"WITH {SQL_SCORE} SELECT c_custkey, round(score, 4) AS score FROM points")
def scorecard_points(t: Tables) -> DataFrame:
    return evaluate.scorecard(scored(t), "p_bad").select("c_custkey", F.round("score", 4).alias("score"))


@query("scorecard_decisions", f"""
WITH {SQL_SCORE}, d AS (SELECT CASE WHEN score > {SQL_CUT} THEN 'accept' ELSE 'reject' END AS decision, bad FROM points)
SELECT decision, bad, count(*)::BIGINT AS n_rows, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM d), 2) AS pct
FROM d GROUP BY ALL""")
def scorecard_decisions(t: Tables) -> DataFrame:
    decided = evaluate.decide(evaluate.scorecard(scored(t), "p_bad"), POINTS_CUT)
    return aggregates.with_share(aggregates.count_by(decided, ["decision", "bad"]), "n_rows")


@query("score_by_outcome", f"""
WITH {SQL_SCORE} SELECT bad, 'score' AS column_name, round(min(score), 4) AS min_value, round(quantile_cont(score, 0.25), 4) AS q1,
round(quantile_cont(score, 0.5), 4) AS median, round(avg(score), 4) AS mean_value, round(quantile_cont(score, 0.75), 4) AS q3,
round(max(score), 4) AS max_value, count(*) FILTER (WHERE score IS NULL)::BIGINT AS n_null FROM points GROUP BY 1""")
def score_by_outcome(t: Tables) -> DataFrame:
    table = aggregates.summary(evaluate.scorecard(scored(t), "p_bad"), ["score"], ["bad"])
    return table.withColumns({"min_value": F.round("min_value", 4), "max_value": F.round("max_value", 4)})


@query("profit_impact", f"""
WITH {SQL_SCORE}, c AS (SELECT count(*)::BIGINT AS n_all, sum(bad)::BIGINT AS bad_all,
count(*) FILTER (WHERE score > {SQL_CUT})::BIGINT AS n_accepted,
count(*) FILTER (WHERE score > {SQL_CUT} AND bad = 1)::BIGINT AS bad_accepted FROM points),
p AS (SELECT *, (100 * (n_all - bad_all) - 5 * n_all - 1500 * bad_all)::DOUBLE AS profit_without,
(100 * (n_accepted - bad_accepted) - 5 * n_accepted - 1500 * bad_accepted)::DOUBLE AS profit_with,
(1500 * (bad_all - bad_accepted))::DOUBLE AS loss_avoided FROM c)
SELECT *, round(100 * ((profit_with - profit_without) / abs(profit_without)), 4) AS gain_pct FROM p""")
def profit_impact(t: Tables) -> DataFrame:
    points = evaluate.scorecard(scored(t), "p_bad")
    return evaluate.profit_impact(points, F.col("bad") == 1, F.col("score") > POINTS_CUT)


# --- fitted models -------------------------------------------------------------------------------------------------

@query("logit_coefficients", """
WITH g AS (SELECT o_orderpriority AS code, avg((o_orderstatus = 'F')::INT) AS p FROM orders GROUP BY 1),
b AS (SELECT ln(p / (1 - p)) AS b FROM g ORDER BY code LIMIT 1)
SELECT CASE WHEN code = (SELECT min(code) FROM g) THEN '(intercept)' ELSE 'code_' || code END AS term,
round(CASE WHEN code = (SELECT min(code) FROM g) THEN (FROM b) ELSE ln(p / (1 - p)) - (FROM b) END, 5) AS estimate FROM g""")
def logit_coefficients(t: Tables) -> DataFrame:
    coded = prep.dummies(t.orders.select((F.col("o_orderstatus") == "F").cast("int").alias("y"),
                                         F.col("o_orderpriority").alias("code")), ["code"])
    fit = models.fit_logit(coded, "y", [c for c in coded.columns if c != "y"])
    return fit.table(t.orders, 5).select("term", "estimate")


@query("logit_step_path")
def logit_step_path(t: Tables) -> DataFrame:
    rows = materialise(applicants(t).fillna(0.0), "applicants")
    path = models.step_aic(rows, "bad", ["n_orders", "avg_total", "max_total"], "logit")
    rows = [(p["step"], p["action"], p["term"], round(p["aic"], 4)) for p in path]
    return t.spark.createDataFrame(rows, "step int, action string, term string, aic double")


# --- from a fitted score to decisions, and the rows without an outcome ----------------------------------------------

CUTOFFS = [round(0.40 + 0.004 * i, 3) for i in range(51)]
SQL_FITTED = f"""known AS (SELECT o_orderkey, o_orderpriority AS code, (o_orderstatus = 'F')::INT AS bad,
left(md5(o_orderkey::VARCHAR || ':11'), 8) < '{sampling.share_of_hashes(0.7)}' AS train FROM orders WHERE o_orderstatus <> 'P'),
rates AS (SELECT code, avg(bad) AS p FROM known WHERE train GROUP BY 1),
held AS (SELECT bad, p FROM known JOIN rates USING (code) WHERE NOT train),
sweep AS (SELECT c AS cutoff, round(sum(bad) FILTER (p >= c)::DOUBLE / sum(bad), 6) AS sensitivity,
  round(sum(1 - bad) FILTER (p < c)::DOUBLE / sum(1 - bad), 6) AS specificity,
  round(avg(((p >= c)::INT = bad)::INT), 6) AS accuracy
  FROM held, (SELECT unnest({CUTOFFS})::DOUBLE AS c) GROUP BY c),
best AS (SELECT cutoff, coalesce(sensitivity, 0) AS sensitivity, coalesce(specificity, 0) AS specificity, accuracy FROM sweep
  ORDER BY round(abs(coalesce(sensitivity, 0) - coalesce(specificity, 0)), 9), cutoff LIMIT 1)"""


def fitted_on_known(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training and held-out rows with an outcome, and rows without, each with the fitted chance ``p`` of the bad outcome.

    One dummy per code makes the fit a saturated one, whose values are the event rates of the codes.
    """
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("code"))
    coded = prep.dummies(rows.withColumn("kind", F.col("code")), ["kind"])
    xs = [c for c in coded.columns if c.startswith("kind_")]
    parts = sampling.split(coded.withColumn("bad", (F.col("o_orderstatus") == "F").cast("int")), "o_orderkey", 0.7, 11)
    known = parts.where("o_orderstatus <> 'P'")
    scored_by = models.linear_score(models.fit_logit(known.where("part = 'train'"), "bad", xs))
    return tuple(df.withColumn("p", scored_by) for df in (
        known.where("part = 'train'"), known.where("part = 'test'"), parts.where("o_orderstatus = 'P'")))


def fitted_cutoff(held: DataFrame) -> DataFrame:
    return evaluate.best_cutoff(evaluate.threshold_sweep(held, "bad", "p", CUTOFFS))


@query("fitted_score_cutoff", f"WITH {SQL_FITTED} SELECT * FROM best")
def fitted_score_cutoff(t: Tables) -> DataFrame:
    """The cut-off of a fitted score on held-out rows, and what it reaches there."""
    _, held, _ = fitted_on_known(t)
    return fitted_cutoff(held)


@query("fitted_score_profit", f"""
WITH {SQL_FITTED}, d AS (SELECT bad, p < (SELECT cutoff FROM best) AS taken FROM held),
c AS (SELECT count(*)::BIGINT AS n_all, sum(bad)::BIGINT AS bad_all, count(*) FILTER (taken)::BIGINT AS n_accepted,
count(*) FILTER (taken AND bad = 1)::BIGINT AS bad_accepted FROM d),
q AS (SELECT *, (100 * (n_all - bad_all) - 5 * n_all - 1500 * bad_all)::DOUBLE AS profit_without,
(100 * (n_accepted - bad_accepted) - 5 * n_accepted - 1500 * bad_accepted)::DOUBLE AS profit_with,
(1500 * (bad_all - bad_accepted))::DOUBLE AS loss_avoided FROM c)
SELECT *, round(100 * ((profit_with - profit_without) / abs(profit_without)), 4) AS gain_pct FROM q""")
def fitted_score_profit(t: Tables) -> DataFrame:
    """Score card points of the held-out rows, decisions at the cut-off found there, and the profit of both."""
    _, held, _ = fitted_on_known(t)
    limit = evaluate.points_at(fitted_cutoff(held).first()["cutoff"])
    return evaluate.profit_impact(evaluate.scorecard(held, "p"), F.col("bad") == 1, F.col("score") > limit)


@query("unlabelled_scores", f"""
WITH {SQL_FITTED}, everyone AS (SELECT 'known' AS population, p FROM held
UNION ALL SELECT 'unknown', p FROM (SELECT o_orderpriority AS code FROM orders WHERE o_orderstatus = 'P') JOIN rates USING (code))
SELECT population, CASE WHEN p < (SELECT cutoff FROM best) THEN 'accept' ELSE 'reject' END AS decision, count(*)::BIGINT AS n_rows,
round(avg(400 - 20 / ln(2) * ln(10) + 20 / ln(2) * ln((1 - p) / p)), 3) AS mean_score FROM everyone GROUP BY ALL""")
def unlabelled_scores(t: Tables) -> DataFrame:
    """Held-out rows and rows without an outcome under the same model, score card and cut-off."""
    _, held, unknown = fitted_on_known(t)
    limit = evaluate.points_at(fitted_cutoff(held).first()["cutoff"])
    both = held.select(F.lit("known").alias("population"), "p").unionByName(unknown.select(F.lit("unknown").alias("population"), "p"))
    decided = evaluate.decide(evaluate.scorecard(both, "p"), limit)
    return decided.groupBy("population", "decision").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("score"), 3).alias("mean_score"))
