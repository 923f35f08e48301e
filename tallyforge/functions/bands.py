"""Banding and value-limiting expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _number(x: float) -> str:
    return f"{x:.10g}"


def cut_labels(breaks: Sequence[float], include_lowest: bool = False) -> list[str]:
    labels = [f"({_number(a)},{_number(b)}]" for a, b in zip(breaks, breaks[1:])]
    if include_lowest:
        labels[0] = "[" + labels[0][1:]
    return labels


def cut(value: Column | str, breaks: Sequence[float], labels: Sequence[str] | None = None,
        include_lowest: bool = False) -> Column:
    """Right-closed interval labels ``(a,b]``; values outside all intervals give null."""
    value = _col(value)
    labels = list(labels or cut_labels(breaks, include_lowest))
    above = (value >= breaks[0]) if include_lowest else (value > breaks[0])
    result = F.when(above & (value <= breaks[1]), labels[0])
    for low, high, label in zip(breaks[1:], breaks[2:], labels[1:]):
        result = result.when((value > low) & (value <= high), label)
    return result


def bucket(value: Column | str, edges: Sequence[float], labels: Sequence[str], other: str) -> Column:
    """Left-closed buckets ``[a,b)``; everything else, nulls too, goes to ``other``."""
    value = _col(value)
    result = F.when((value >= edges[0]) & (value < edges[1]), labels[0])
    for low, high, label in zip(edges[1:], edges[2:], labels[1:]):
        result = result.when((value >= low) & (value < high), label)
    return result.otherwise(other)


def quartile_band(value: Column | str, q1: float, q2: float, q3: float,
                  labels: Sequence[str] = ("q1", "q2", "q3", "q4")) -> Column:
    value = _col(value)
    return F.when(value <= q1, labels[0]).when(value <= q2, labels[1]).when(value <= q3, labels[2]).when(
        value > q3, labels[3])


def round_breaks(low: float | None, high: float | None, n: int = 5) -> list[float]:
    """About ``n`` intervals on round steps (1, 2, 5 times a power of ten) that cover ``low`` to ``high``; of an empty column, nulls, any."""
    if low is None or high is None:
        return [0.0, 1.0]
    if high <= low:
        return [low - 1, low]
    raw = (high - low) / n
    power = 10 ** math.floor(math.log10(raw))
    step = min((m * power for m in (1, 2, 5, 10)), key=lambda s: abs(math.log(s / raw)))
    first, last = math.floor(low / step + 1e-9), math.ceil(high / step - 1e-9)
    return [round(i * step, 10) for i in range(first, last + 1)]


def clamp(value: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value to fixed bounds; null stays null."""
    value = _col(value)
    result = value
    if low is not None:
        result = F.when(value < low, F.lit(low)).otherwise(result)
    if high is not None:
        result = F.when(value > high, F.lit(high)).otherwise(result)
    return result


def member_group(value: Column | str, groups: Mapping[str, Sequence[object]]) -> Column:
    """Collect listed members under one label; all others keep their own."""
    value = _col(value)
    result = value
    for label, members in groups.items():
        result = F.when(value.isin(list(members)), F.lit(label)).otherwise(result)
    return result


def own_level(value: Column | str, label: str = "NA") -> Column:
    """Give nulls a level of their own."""
    return F.coalesce(_col(value).cast("string"), F.lit(label))
