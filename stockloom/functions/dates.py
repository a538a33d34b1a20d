"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Demand factors by month (January first), weekday (Monday first) and hour.
MONTH_FACTORS = [0.8, 0.85, 0.9, 0.95, 1.0, 1.05, 1.1, 1.15, 1.1, 1.05, 1.2, 1.3]
WEEKDAY_FACTORS = [0.7, 0.8, 0.9, 1.0, 1.2, 1.5, 1.1]
HOUR_FACTORS = [
    0.2, 0.1, 0.05, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.9, 1.0, 1.1,
    1.2, 1.15, 1.1, 1.05, 1.1, 1.2, 1.3, 1.4, 1.2, 0.8, 0.5, 0.3,
]
# Dayparts as name, first hour, hour after the last.
DAYPARTS = [("morning", 5, 10), ("lunch", 11, 14), ("evening", 17, 21)]

PERIODS = ("hour", "day", "week", "month")
_DAY_MICROS = 24 * 60 * 60 * 1_000_000


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded down (half a day back is -1)."""
    return F.floor(F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(_DAY_MICROS)).cast("long")


def period_key(ts: Column, period: str) -> Column:
    """Text key of the hour, day, week or month. Weeks start on Sunday, the first one is 01."""
    if period == "hour":
        return F.date_format(ts, "yyyy-MM-dd HH:00")
    if period == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if period == "month":
        return F.date_format(ts, "yyyy-MM")
    if period == "week":
        week = F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7)
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))
    raise ValueError(f"unknown period {period!r}, use one of {PERIODS}")


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Weekday (Monday is 0), day of month and month."""
    return {
        "day_of_week": F.weekday(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
    }


def daypart(ts: Column) -> Column:
    hour = F.hour(ts)
    column = None
    for name, first, end in DAYPARTS:
        inside = (hour >= first) & (hour < end)
        column = F.when(inside, name) if column is None else column.when(inside, name)
    return column.otherwise("other")


def demand_factor(ts: Column, seasonal: bool = True) -> Column:
    """How busy a moment usually is: month x weekday x hour."""

    def factor(values: list[float], position: Column) -> Column:
        return F.element_at(F.array([F.lit(v) for v in values]), position)

    result = factor(WEEKDAY_FACTORS, F.weekday(ts) + 1) * factor(HOUR_FACTORS, F.hour(ts) + 1)
    return factor(MONTH_FACTORS, F.month(ts)) * result if seasonal else result
