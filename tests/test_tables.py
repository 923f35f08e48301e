"""Columns, quality, joins, aggregates, windows and reshaping on small literals."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.operators import aggregates, charts, columns, joins, quality, reshape, windows


# --- columns
def test_normalise_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], " `  Summons Number ` int, `Unregistered Vehicle?` int, Plain int")
    assert columns.normalise_columns(df).columns == ["summons_number", "unregistered_vehicle", "plain"]


def test_null_columns(spark):
    df = spark.createDataFrame([(i, None, i if i else None, "") for i in range(30)], "a int, b int, c int, d string")
    assert columns.drop_all_null(df).columns == ["a", "c", "d"]
    assert columns.keep_by_null_share(df, 0.05).columns == ["a", "c", "d"]
    assert columns.keep_by_null_share(df, 0.03).columns == ["a", "d"]


def test_casts_and_names(spark, rows):
    df = spark.createDataFrame([("1", "x"), ("two", "y")], "a string, b string")
    assert rows(columns.cast_columns(df, {"a": "int"}), "a") == [(None,), (1,)]
    assert columns.rename(df, {"a": "n"}).columns == ["n", "b"]
    assert columns.drop(columns.tag(df, "fy", 2015), ["b"]).first() == ("1", 2015)
    both = columns.bind_columns(df, df.select("a", F.upper("b").alias("B2")), "a")
    assert rows(both) == [("1", "x", "X"), ("two", "y", "Y")]
    assert columns.shape(df).first() == (2, 2)


# --- quality
def fault_rules():
    return {"late": F.col("start") >= F.col("end"), "many": ~F.col("n").isin(1, 2)}


def clean_rules():
    return {"late": F.col("start") < F.col("end"), "many": F.col("n").isin(1, 2)}


TRIPS = [("v", 1, 2, 1), ("v", 2, 2, 1), ("v", 3, 2, 9), ("w", 1, None, 1), ("w", 1, None, 9), ("w", 1, 5, 2)]


def test_fault_rules(spark, rows):
    df = spark.createDataFrame(TRIPS, "vendor string, start int, end int, n int")
    assert rows(quality.fault_counts(df, fault_rules(), ["vendor"])) == [("v", 3, 2, 2, 1), ("w", 3, 1, 0, 1)]
    assert rows(quality.fault_rate(df, fault_rules(), ["vendor"], 2)) == [("v", 3, 66.67), ("w", 3, 33.33)]
    # a row with a null input is neither faulty nor clean, unless another rule already decides
    faulty = df.where(quality.any_rule(fault_rules())).count()
    assert (faulty, quality.keep_clean(df, clean_rules()).count(), df.count()) == (3, 2, 6)
    assert rows(quality.violations(df, fault_rules())) == [("late", 2), ("many", 2)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(0, 3)), min_size=1, max_size=30))
def test_faulty_and_clean_are_complements(spark, data):
    df = spark.createDataFrame(data, "start int, end int, n int")
    assert df.where(quality.any_rule(fault_rules())).count() + quality.keep_clean(df, clean_rules()).count() == len(data)


def test_profiles(spark, rows):
    df = spark.createDataFrame([(1, "a", 2.0), (None, "", 3.0), (3, "", None), (3, None, 1.0)], "i int, s string, x double")
    assert rows(quality.null_profile(df)) == [("i", 1), ("s", 1), ("x", 1)]
    assert rows(quality.blank_profile(df)) == [("s", 2, 50.0)]
    assert rows(quality.domain_profile(df, ["i", "x"])) == [("i", 1.0, 3.0, 1), ("x", 1.0, 3.0, 1)]
    assert rows(quality.complete_cases(df)) == [(1, "a", 2.0)]
    assert rows(quality.complete_cases(df, ["i", "x"]), "i") == [(1,)] + [(3,)]
    assert rows(quality.uniqueness(df, ["i", "s"])) == [("i", 2, 1), ("s", 2, 1)]
    assert rows(quality.null_by_label(df, "i", "s")) == [("", 1)]
    assert rows(quality.value_counts(df, "s")) == [(None, 1), ("", 2), ("a", 1)]


def test_dedupe(spark, rows):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, "c", 1), (None, "d", 1), (None, "e", 0)], "k int, v string, at int")
    assert rows(quality.dedupe(df, "k", ["at"])) == [(None, "e", 0), (1, "b", 2), (2, "c", 1)]
    assert quality.dedupe(df, "k").count() == 3
    quality.assert_unique_key(df, ["k", "v"])
    with pytest.raises(ValueError):
        quality.assert_unique_key(df, "k")


# --- joins
def test_lookup_join_with_hot_key(spark, rows):
    fact = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(300)], "k int, i int")
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(300)], "k int, d string")
    assert joins.lookup_join(fact, dim, "k").count() == 300
    orphans = fact.unionByName(spark.createDataFrame([(None, -1), (None, -3), (999, -2)], "k int, i int"))
    left = joins.lookup_join(orphans, dim, "k", "left")
    assert left.columns == ["k", "i", "d"]
    assert rows(left) == rows(orphans.join(dim, "k", "left"))
    assert joins.lookup_join(orphans, dim, "k").count() == 300
    twice = joins.lookup_join(fact, dim.unionByName(dim), "k")
    assert twice.count() == 600  # one row per matching row of the lookup, whatever the size



def test_null_safe_join(spark, rows):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("b", 30)], "k string, y int")
    assert rows(joins.null_safe_join(left, right, ["k"])) == [(None, 1, 10), ("a", 2, 20)]


def test_merge(spark, rows):
    a = spark.createDataFrame([(1, 0, "x"), (2, None, "y"), (3, 1, "z")], "id int, tag int, s string")
    b = spark.createDataFrame([(1, 0, 5.0), (2, 1, 6.0), (4, 1, 7.0)], "id int, tag int, n double")
    merged, conflicts = joins.merge_checked(a, b, "id")
    assert rows(conflicts) == [("tag", 1)]
    assert rows(merged, "id", "s", "tag", "n") == [(1, "x", 0, 5.0), (2, "y", 1, 6.0)]
    three = joins.merge_all([a.select("id"), a.select("id", "s"), b.select("id", "n")], "id")
    assert rows(three) == [(1, "x", 5.0), (2, "y", 6.0)]
    assert rows(quality.missing_keys(a, b, "id")) == [(3,)]


def test_lookups(spark, rows):
    df = spark.createDataFrame([("maxda",), ("vw",), ("audi",), (None,)], "c string")
    fixed = df.select(joins.map_values("c", {"maxda": "mazda", "vw": "volkswagen"}).alias("c"))
    assert rows(fixed) == [(None,), ("audi",), ("mazda",), ("volkswagen",)]
    matrix = spark.createDataFrame([("analytics", 1, 0), ("enterprise 2.0", 0, 1), ("nanotechnology", 0, 1), ("", 1, 0)],
                                   "category string, data int, `clean, tech` int")
    raw = spark.createDataFrame([("A0lytics",), ("Enterprise 2.0",), ("0notechnology",), ("none",), ("",)], "category string")
    repaired = raw.select(joins.repair_na_spelling(F.col("category")).alias("category"))
    assert rows(joins.onehot_lookup(repaired, matrix, "category")) == [
        ("", "data"), ("analytics", "data"), ("enterprise 2.0", "clean, tech"), ("nanotechnology", "clean, tech"), ("none", None)]


# --- aggregates
def test_group_extremes(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",)], "g string")
    assert rows(aggregates.extreme_groups(df, ["g"], F.count(F.lit(1)), "n")) == [("a", 2), ("b", 2)]
    assert rows(aggregates.extreme_groups(df, ["g"], F.count(F.lit(1)), "n", largest=False)) == [("c", 1)]
    assert [tuple(r) for r in aggregates.top_groups(df, ["g"], F.count(F.lit(1)), 2, "n").collect()] == [("a", 2), ("b", 2)]
    assert rows(aggregates.with_share(aggregates.count_by(df, ["g"]), "n_rows")) == [("a", 2, 40.0), ("b", 2, 40.0), ("c", 1, 20.0)]
    assert aggregates.mode_of(df, "g").first() == ("a", 2)


def test_counts_and_rates(spark, rows):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, None), ("b", None, 3.0)], "g string, v int, x double")
    assert rows(aggregates.count_distinct_by(df, "v", ["g"])) == [("a", 1), ("b", 0)]
    assert rows(aggregates.rate_by(df, F.col("x") > 2, ["g"])) == [("a", 2, 0, 0.0), ("b", 1, 1, 1.0)]
    assert rows(aggregates.sum_where(df, "g", ["b", "z"], "x")) == [("b", 3.0), ("z", None)]
    assert df.agg(aggregates.avg_where("x", F.col("g") == "a")).first()[0] == 1.0
    rate = aggregates.avg_rate_per_hour(F.col("x"), F.col("v") * 0)
    assert df.agg(rate).first()[0] is None


def test_holders(spark, rows):
    df = spark.createDataFrame([(1, "m1", 5.0, 1.0), (2, "m2", 9.0, 7.0), (3, "m3", 9.0, None), (4, "m4", 5.0, 7.0)],
                               "id int, name string, t double, o double")
    assert rows(aggregates.argmax(df, "t", "id", ["name"])) == [("m2",)]
    assert rows(aggregates.argmax_many(df, ["t", "o"], "name", "id")) == [("o", "m2", 7.0), ("t", "m2", 9.0)]
    assert rows(aggregates.nth_largest(df, "t", 2), "name") == [("m1",), ("m4",)]
    assert aggregates.nth_largest(df, "t", 3).count() == 0


def test_summary(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("a", None), (None, 4.0)], "g string, x double")
    assert rows(aggregates.summary(df, ["x"], ["g"])) == [
        (None, "x", 4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 0), ("a", "x", 1.0, 1.75, 2.5, 4.0, 4.75, 10.0, 1)]
    assert rows(aggregates.summary(df, ["x"]))[0][1:] == (1.0, 2.0, 3.0, 4.0, 4.0, 10.0, 1)


def test_drilldown(spark, rows):
    df = spark.createDataFrame([("p", "east", -5.0), ("p", "west", 1.0), ("q", "east", 9.0), ("p", "east", -1.0)], "c string, r string, x double")
    totals = df.groupBy("c").agg(F.sum("x").alias("total"))
    assert rows(aggregates.drilldown_worst(totals, df, "c", "r", "x")) == [("p", "east", 2, -6.0), ("p", "west", 1, 1.0)]


def test_correlations(spark, rows):
    df = spark.createDataFrame([(float(i), float(2 * i), float(-i) if i else None) for i in range(5)], "a double, b double, c double")
    assert rows(aggregates.corr_long(df, ["a", "b", "c"])) == [("a", "b", 1.0), ("a", "c", -1.0), ("b", "c", -1.0)]


# --- windows
def test_top_k_per_keeps_ties(spark, rows):
    data = [("bin", c) for c in "aaaabbbccdde"] + [("few", "z")]
    df = spark.createDataFrame(data, "b string, c string")
    assert rows(windows.top_k_per(df, ["b"], ["c"], 3)) == [
        ("bin", "a", 4, 1), ("bin", "b", 3, 2), ("bin", "c", 2, 3), ("bin", "d", 2, 3), ("few", "z", 1, 1)]


def test_members_and_order(spark, rows):
    df = spark.createDataFrame([("x", 5), ("y", 7), ("z", 7), (None, 99), ("w", 50)], "d string, v int")
    assert rows(windows.top_members(df, "d", F.sum("v"), 2, exclude=["w"]), "d") == [("y",), ("z",)]
    top = windows.top_members(df, "d", F.sum("v"), 2, exclude=["w"])
    assert rows(joins.semi_join_top(df, top, "d", 2)) == [("y", 7), ("z", 7)]
    assert [r["v"] for r in windows.last_n(df.na.drop(), ["v", "d"], 2).collect()] == [7, 50]
    assert [r["s"] for r in windows.cumulative(df.na.drop(), "d", "v", "s").orderBy("d").collect()] == [50, 55, 62, 69]
    ranked = windows.row_index_per(df.na.drop().withColumn("p", F.lit(1)), ["p"], [F.col("v").desc(), F.col("d")], 2)
    assert rows(ranked, "d", "idx") == [("w", 1), ("y", 2)]


def test_priced_top_k(spark, rows):
    df = spark.createDataFrame([(21,)] * 3 + [(38,)] * 2 + [(14,)] * 2 + [(1,)], "code int")
    prices = spark.createDataFrame([(21, 55.0), (38, 50.0), (14, 115.0)], "code int, price double")
    assert rows(windows.priced_top_k(df, "code", prices, 2)) == [(14, 2, 115.0, 230.0), (21, 3, 55.0, 165.0)]


# --- reshape
def test_stack_and_difference(spark, rows):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2)], "s string, i int")
    assert rows(reshape.stack(a, b)) == [(1, "x"), (2, "y")]
    assert rows(reshape.stack_tagged({2015: a, 2016: b}, "fy")) == [(1, "x", 2015), (2, "y", 2016)]
    assert rows(reshape.setdiff(reshape.stack(a, b), a, "i")) == [(2, "y")]


def test_gap(spark, rows):
    data = [("Airport", "Done")] * 3 + [("Airport", "Cancelled")] * 2 + [("City", "Cancelled")]
    df = spark.createDataFrame(data, "p string, s string")
    assert rows(reshape.pivot_counts(df, ["p"], "s", ["Done", "Cancelled", "No Cars"])) == [("Airport", 3, 2, 0), ("City", 0, 1, 0)]
    assert rows(reshape.demand_supply_gap(df, ["p"], "s", "Done")) == [("Airport", 5, 3, 2), ("City", 1, 0, 1)]


def test_attendance(spark, rows):
    starts = spark.sql("SELECT 1 id, timestamp_ntz'2015-01-01 09:00:00' d1, timestamp_ntz'2015-01-02 09:30:00' d2, "
                       "cast(null as timestamp_ntz) d3 UNION ALL SELECT 2, null, null, null")
    ends = spark.sql("SELECT 2 id, cast(null as timestamp_ntz) d1, cast(null as timestamp_ntz) d2, cast(null as timestamp_ntz) d3 "
                     "UNION ALL SELECT 1, timestamp_ntz'2015-01-01 17:00:00', timestamp_ntz'2015-01-02 20:00:00', null")
    long = reshape.interval_hours(starts, ends, "id", ["d1", "d2", "d3"])
    assert rows(long) == [(1, "d1", 8.0), (1, "d2", 10.5), (1, "d3", None), (2, "d1", None), (2, "d2", None), (2, "d3", None)]
    assert rows(reshape.row_mean_and_gaps(long, "id", "hours")) == [(1, 9.25, 1), (2, None, 3)]
    assert rows(reshape.attendance_features(long, "id", "hours")) == [(1, 9.25, 1, 1, 0), (2, None, 3, None, None)]
    assert rows(reshape.active_days(long, "day", "hours")) == [("d1", 1), ("d2", 1)]


def test_unpivot_reverses_pivot(spark, rows):
    long = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7), (2, "b", 8)], "i int, k string, v int")
    wide = long.groupBy("i").pivot("k", ["a", "b"]).agg(F.first("v"))
    assert rows(reshape.unpivot(wide, ["i"], ["a", "b"], "k", "v")) == rows(long)


# --- charts
def test_charts(spark, rows):
    df = spark.createDataFrame([("a", "y", 0.0), ("a", "n", 1.0), ("a", "n", 5.0), ("b", "y", 10.0)], "x string, f string, v double")
    assert rows(charts.bar_counts(df, "x", "f")) == [("a", "n", 2), ("a", "y", 1), ("b", "y", 1)]
    assert rows(charts.bar_share(df, "x")) == [("a", 3, 75.0), ("b", 1, 25.0)]
    assert rows(charts.stack_share(df, "x", "f", 2)) == [("a", "n", 2, 66.67), ("a", "y", 1, 33.33), ("b", "y", 1, 100.0)]
    assert rows(charts.histogram(df, "v", 5)) == [(1, 2), (3, 1), (5, 1)]
    assert rows(charts.histogram(df.where("v = 5"), "v", 5)) == [(1, 1)]
    assert charts.histogram(df.where("v > 50"), "v", 5).count() == 0
    assert rows(charts.bars_long(df, ["x", "f"])) == [("f", "n", 2), ("f", "y", 2), ("x", "a", 3), ("x", "b", 1)]
    assert set(charts.facets(df, ["x", "f"])) == {"x", "f"}
