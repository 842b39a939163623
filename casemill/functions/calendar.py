"""Months, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def shift_month(day: Column, months: int) -> Column:
    return F.add_months(F.trunc(day, "month"), months)


def month_index(day: Column) -> Column:
    """Months since year 0: neighbours differ by one, gaps by more."""
    return F.year(day) * 12 + F.month(day) - 1


def month_of(index: Column) -> Column:
    """The first day of a month, from its index."""
    return F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1))


def utc_date(moment: Column) -> Column:
    """Calendar day; the session's time zone is UTC."""
    return F.to_date(moment)


def parse_date(text: Column) -> Column:
    """Y-m-d, Y/m/d or d/m/Y with four-digit years; null for anything else."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    first = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "y-M-d"))
    second = F.when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(t, "y/M/d"))
    third = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "d/M/y"))
    return F.coalesce(first, second, third)


#: How many months each named period spans.
PERIOD_MONTHS = {"last_3_months": 3, "last_6_months": 6, "last_12_months": 12}


def period_bounds(requests: DataFrame) -> DataFrame:
    """requests (period, period_start, period_end, reference, today) with bounds a and b; null bounds where no reference month is known."""
    months = F.lit(None).cast("int")
    for name, n in PERIOD_MONTHS.items():
        months = F.when(F.col("period") == name, n).otherwise(months)
    custom, current = F.col("period") == "custom", F.col("period") == "current_month"
    a = F.when(custom, F.col("period_start")).when(current, F.trunc("today", "month")).otherwise(F.add_months(F.trunc("reference", "month"), 1 - months))
    b = F.when(custom, F.col("period_end")).when(current, F.last_day("today")).otherwise(F.last_day("reference"))
    return requests.withColumn("a", a).withColumn("b", b)


def monthly_timeline(series: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """A row for every month from a series' first to its last; null values in the gaps."""
    span = series.groupBy(*keys).agg(F.min(month).alias("a"), F.max(month).alias("b"))
    span = span.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias(month))
    return span.join(series.select(*keys, month, value), [*keys, month], "left")
