"""Periods and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_period(day: Column, count: Column, unit: Column) -> Column:
    """Days are added; months and years by calendar, clamped to the month's end."""
    months = F.when(unit == "year", count * 12).otherwise(count)
    return F.when(unit == "day", F.date_add(day, count)).otherwise(F.add_months(day, months))


def period_text(count: Column, unit: Column) -> Column:
    return F.concat(count.cast("string"), F.lit(" "), unit, F.when(count == 1, "").otherwise("s"))


def anniversary(day: Column, years: int = 10) -> Column:
    return F.add_months(day, 12 * years)


def governing_code(day: Column, cut_over: str, before: str, after: str) -> Column:
    """By the cut-over date; ``ask`` for an unknown date."""
    return F.when(day.isNull(), "ask").when(day < F.lit(cut_over).cast("date"), before).otherwise(after)
