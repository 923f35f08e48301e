"""Date and time expressions. All of them ignore the session time zone for zone-less timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six four-hour bins and their order.
TIME_BINS = ["0to3", "4to7", "8to11", "12to15", "16to19", "20to23"]
# The parts of the day and the seasons in order.
DAY_SLOTS = ["Mid Night", "Early Morning", "Late Morning", "Afternoon", "Evening", "Late Evening"]
SEASONS = ["winter", "spring", "summer", "fall"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fiscal_year(date: Column | str, first_month: int = 10) -> Column:
    """Year in which a fiscal year starting in ``first_month`` ends."""
    date = _col(date)
    return (F.year(date) + F.when(F.month(date) >= first_month, 1).otherwise(0)).cast("bigint")


def in_fiscal_year(date: Column | str, year: int, first_month: int = 10) -> Column:
    """Range condition on the bare column, so that it can be pushed into the scan."""
    date = _col(date)
    start = F.lit(f"{year - 1}-{first_month:02d}-01").cast("timestamp_ntz")
    end = F.lit(f"{year}-{first_month:02d}-01").cast("timestamp_ntz")
    return (date >= start) & (date < end)


def _pick(names: Sequence[str], index: Column) -> Column:
    """Name at an index, null outside; the index is worked out once, unlike in a chain of conditions."""
    return F.get(F.array(*[F.lit(n) for n in names]), index)


def time_bin(hour: Column | str, nulls_to_last: bool = False) -> Column:
    """Four-hour bin of an hour 0-23. Unknown hours stay null unless they should fall in the last bin."""
    label = _pick(TIME_BINS, F.floor(_col(hour) / 4).cast("int"))
    return F.coalesce(label, F.lit(TIME_BINS[-1])) if nulls_to_last else label


def day_slot(hour: Column | str) -> Column:
    """Named part of the day; each slot excludes its first hour and includes its last."""
    return _pick([DAY_SLOTS[0], *DAY_SLOTS], F.ceil(_col(hour) / 4).cast("int"))


def season(month: Column | str) -> Column:
    """Season of a month; December belongs to winter."""
    return _pick(SEASONS, F.floor(_col(month) % 12 / 3).cast("int"))


def hour_from_12h_text(text: Column | str) -> Column:
    """Hour 0-23 of texts like ``0953A`` or ``1215P``; anything else gives null."""
    text = _col(text)
    hour = F.substring(text, 1, 2).try_cast("int") % 12
    valid = text.rlike("^(0[1-9]|1[0-2])[0-5][0-9][AP]$")
    return F.when(valid, hour + F.when(F.substring(text, 5, 1) == "P", 12).otherwise(0)).cast("bigint")


def parse_timestamp(text: Column | str, patterns: Sequence[str]) -> Column:
    """First pattern that fits wins; null when none does."""
    text = _col(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in patterns])


def parse_month_year(text: Column | str) -> Column:
    """First day of a month given like ``Dec-11``; years 69 to 99 belong to the last century."""
    day = F.try_to_timestamp(F.concat(F.lit("01-"), _col(text)), F.lit("dd-MMM-yy")).cast("date")
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def parse_date(text: Column | str, pattern: str = "MM/dd/yyyy") -> Column:
    return F.try_to_timestamp(_col(text), F.lit(pattern)).cast("date")


def weekday_label(ts: Column | str) -> Column:
    """Sun, Mon, ... - built from the day number, so it does not depend on a locale."""
    return _pick(["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"], F.dayofweek(_col(ts)) - 1)


def time_text(ts: Column | str) -> Column:
    """``HH:mm:ss`` of a timestamp."""
    ts = _col(ts)
    two = [F.lpad(part.cast("int").cast("string"), 2, "0") for part in (F.hour(ts), F.minute(ts), F.second(ts))]
    return F.concat_ws(":", *two)


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("SECOND", _col(start), _col(end))


def elapsed_minutes(start: Column | str, end: Column | str) -> Column:
    return elapsed_seconds(start, end) / 60.0


def elapsed_hours(start: Column | str, end: Column | str) -> Column:
    return elapsed_seconds(start, end) / 3600.0
