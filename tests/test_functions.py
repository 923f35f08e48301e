"""Date, text and banding expressions, with the edge cases of the source data."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import bands, dates, text


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_hour_from_12h_text(spark):
    texts = ["1200A", "1215A", "1200P", "0953A", "1259P", "0060A", "1300P", "0A", "", None, "0520P"]
    assert column(spark, texts, "string", dates.hour_from_12h_text) == [0, 0, 12, 9, 12, None, None, None, None, None, 17]


def test_time_bins(spark):
    hours = [0, 3, 4, 11, 12, 19, 20, 23, None]
    want = ["0to3", "0to3", "4to7", "8to11", "12to15", "16to19", "20to23", "20to23", None]
    assert column(spark, hours, "int", dates.time_bin) == want
    assert column(spark, hours, "int", lambda c: dates.time_bin(c, True))[-1] == "20to23"


def test_day_slots(spark):
    hours = [0, 4, 5, 8, 9, 12, 13, 16, 17, 20, 21, 23, None]
    want = ["Mid Night"] * 2 + ["Early Morning"] * 2 + ["Late Morning"] * 2 + ["Afternoon"] * 2 + ["Evening"] * 2 + ["Late Evening"] * 2
    assert column(spark, hours, "int", dates.day_slot) == [*want, None]


def test_seasons(spark):
    assert column(spark, [12, 1, 2, 3, 5, 6, 8, 9, 11, None], "int", dates.season) == [
        "winter", "winter", "winter", "spring", "spring", "summer", "summer", "fall", "fall", None]


def test_fiscal_years(spark):
    stamps = [datetime(2014, 9, 30, 23, 59), datetime(2014, 10, 1), datetime(2015, 9, 30, 12), datetime(2015, 10, 1)]
    assert column(spark, stamps, "timestamp_ntz", dates.fiscal_year) == [2014, 2015, 2015, 2016]
    assert column(spark, stamps, "timestamp_ntz", lambda c: dates.in_fiscal_year(c, 2015)) == [False, True, True, False]


def test_dirty_dates(spark):
    patterns = ["dd-MM-yyyy HH:mm:ss", "d/M/yyyy H:mm"]
    got = column(spark, ["11/7/2016 11:51", "13-07-2016 08:33:16", "", None], "string", lambda c: dates.parse_timestamp(c, patterns))
    assert got == [datetime(2016, 7, 11, 11, 51), datetime(2016, 7, 13, 8, 33, 16), None, None]
    assert column(spark, ["07/04/2015", "bad"], "string", dates.parse_date) == [date(2015, 7, 4), None]
    assert column(spark, ["Dec-11", "Jan-99", "May-68"], "string", dates.parse_month_year) == [
        date(2011, 12, 1), date(1999, 1, 1), date(2068, 5, 1)]


def test_weekday_and_elapsed(spark):
    assert column(spark, [datetime(2016, 7, 11), datetime(2016, 7, 17)], "timestamp_ntz", dates.weekday_label) == ["Mon", "Sun"]
    df = spark.sql("SELECT timestamp_ntz'2016-07-11 11:50:00' a, timestamp_ntz'2016-07-11 13:20:30' b")
    row = df.select(dates.elapsed_minutes("a", "b"), dates.elapsed_hours("a", "b"), dates.time_text("b")).first()
    assert row == (90.5, pytest.approx(90.5 / 60), "13:20:30")


def test_numbers_in_text(spark):
    texts = ["36 months", "10.65%", "< 1 year", "10+ years", "n/a", "1,250.5", "-3", None]
    assert column(spark, texts, "string", text.parse_number) == [36, 10.65, 1, 10, None, 1250.5, -3, None]


def test_words(spark):
    names = ["alfa-romero giulia", "bmw x1 drive", "subaru", None]
    assert column(spark, names, "string", text.first_word) == ["alfa-romero", "bmw", "subaru", None]
    assert column(spark, names, "string", text.rest_after_first_word) == ["giulia", "x1 drive", "missing", "missing"]
    assert column(spark, ["  Unregistered Vehicle? "], "string", text.normalise) == ["unregistered_vehicle"]


def test_bands(spark):
    values = [0.0, 4.99, 5.0, 20.0, -1.0, None]
    got = column(spark, values, "double", lambda c: bands.bucket(c, [0, 5, 10, 20], ["a", "b", "c"], "rest"))
    assert got == ["a", "a", "b", "rest", "rest", "rest"]
    assert column(spark, [1.0, 2.0, 3.0, 4.0, 5.0, None], "double", lambda c: bands.quartile_band(c, 2, 3, 4)) == [
        "q1", "q1", "q2", "q3", "q4", None]
    assert column(spark, ["seed", "angel", "venture", None], "string",
                  lambda c: bands.member_group(c, {"Others": ["seed", "angel"]})) == ["Others", "Others", "venture", None]
    assert column(spark, ["a", None], "string", bands.own_level) == ["a", "NA"]
