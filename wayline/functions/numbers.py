"""Numbers for display: shares, bars, axes, hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 1, of: float = 100.0) -> Column:
    """part / whole as percent; 0 without a whole."""
    return F.round(F.coalesce(F.try_divide(part * of, whole), F.lit(0.0)), digits)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def bar_width(value: Column, most: Column) -> Column:
    """Percent of the largest, at least 2 for what is above 0."""
    return F.when((value > 0) & (most > 0), F.greatest(F.lit(2.0), value / most * 100)).otherwise(0.0)


def open_green(green: Column, shade: Column) -> Column:
    return F.greatest(F.lit(0.0), half_up((green - shade) * 10) / 10)


def axis(low: Column, high: Column, step: float = 5.0) -> tuple[Column, Column]:
    """The range widened to whole steps."""
    return F.floor(low / step) * step, F.ceil(high / step) * step


def ticks(low: Column, high: Column, step: Column) -> Column:
    """Multiples of step from low to high."""
    first, last = F.ceil(low / step), F.floor(high / step)
    return F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), lambda k: k * step)).otherwise(F.array().cast("array<double>"))


def km_step(km: Column) -> Column:
    """Step of a distance axis: 2 km beyond 8 km, else 1."""
    return F.when(km > 8, 2.0).otherwise(1.0)


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9
