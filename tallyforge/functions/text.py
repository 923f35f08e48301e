"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(text: Column | str) -> Column:
    """Trim, blanks to underscores, no question marks, lower case."""
    return F.lower(F.replace(F.regexp_replace(F.trim(_col(text)), r"\s", "_"), F.lit("?"), F.lit("")))


def parse_number(text: Column | str) -> Column:
    """First number in a text such as ``36 months``, ``10.65%`` or ``< 1 year``; null when there is none."""
    found = F.regexp_extract(F.regexp_replace(_col(text), ",", ""), r"-?[0-9]*\.?[0-9]+", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def first_word(text: Column | str) -> Column:
    return F.substring_index(_col(text), " ", 1)


def rest_after_first_word(text: Column | str, missing: str = "missing") -> Column:
    """Everything after the first blank, or ``missing`` when there is no second word."""
    return F.coalesce(F.get(F.split(_col(text), " ", 2), F.lit(1)), F.lit(missing))
