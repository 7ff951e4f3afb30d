"""Exchange calendars as tables, and the grid of expected bars.

A calendar is a DataFrame (session, ordinal, segment, open_t, close_t,
session_open_t) in epoch seconds; breaks make several segments.  Two makers are
given: whole days, and New York equities by rule.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """n-th weekday of a month; n = -1 for the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (date(year, month, 28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7)


def easter(year: int) -> date:
    """Gregorian Easter Sunday, by the anonymous algorithm."""
    a, b, c = year % 19, year // 100, year % 100
    d, e = b // 4, b % 4
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = c // 4, c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return date(year, month, day + 1)


def _observed(day: date) -> date | None:
    """Saturday holidays move to Friday, Sunday ones to Monday."""
    return day - timedelta(days=1) if day.weekday() == 5 else day + timedelta(days=1) if day.weekday() == 6 else day


# Fixed dates on which the exchange was closed for the whole day outside its yearly rules.
SPECIAL_CLOSURES = {date(2001, 9, 11), date(2001, 9, 12), date(2001, 9, 13), date(2001, 9, 14), date(2004, 6, 11), date(2007, 1, 2), date(2012, 10, 29), date(2012, 10, 30), date(2018, 12, 5), date(2025, 1, 9)}


def xnys_holidays(year: int) -> set[date]:
    new_year = date(year, 1, 1)
    days = {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - timedelta(days=2), _nth(year, 5, 0, -1), _observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25))}
    if new_year.weekday() != 5:  # a Saturday New Year is not moved into the old year
        days.add(_observed(new_year))
    if year >= 2022:
        days.add(_observed(date(year, 6, 19)))
    return days | {d for d in SPECIAL_CLOSURES if d.year == year}


def xnys_early_close(day: date) -> bool:
    """13:00 close: the day after Thanksgiving, Christmas Eve, and 3 July, if a session."""
    if day == _nth(day.year, 11, 3, 4) + timedelta(days=1):
        return True
    if (day.month, day.day) == (12, 24):
        return day.weekday() < 4
    return (day.month, day.day) == (7, 3) and day.weekday() in (0, 1, 2, 3)


def xnys_sessions(first: date, last: date) -> list[tuple[date, str, str]]:
    """(session, local open, local close) from ``first`` to ``last``."""
    out, day = [], first
    while day <= last:
        if day.weekday() < 5 and day not in xnys_holidays(day.year):
            out.append((day, f"{day} 09:30:00", f"{day} {'13:00:00' if xnys_early_close(day) else '16:00:00'}"))
        day += timedelta(days=1)
    return out


SEGMENTS = "session date, ordinal int, segment int, open_t long, close_t long, session_open_t long"


def xnys_calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """New York sessions; local times become UTC by the JVM's zone rules."""
    rows = [(day, k, start, end) for k, (day, start, end) in enumerate(xnys_sessions(first, last))]
    table = spark.createDataFrame(rows, "session date, ordinal int, open string, close string")
    # offset of New York at that time, independent of the session's own zone
    utc = lambda c: F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', convert_timezone('America/New_York', 'UTC', cast({c} as timestamp_ntz)))")
    return table.select("session", "ordinal", F.lit(0).alias("segment"), utc("open").alias("open_t"), utc("close").alias("close_t"), utc("open").alias("session_open_t"))


def day_calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Every day a session of 24 hours."""
    n = (last - first).days + 1
    base = (first - date(1970, 1, 1)).days
    return spark.range(n).select(
        F.expr(f"date_add(date'{first}', cast(id as int))").alias("session"), F.col("id").cast("int").alias("ordinal"), F.lit(0).alias("segment"),
        ((F.col("id") + base) * 86400).alias("open_t"), ((F.col("id") + base + 1) * 86400).alias("close_t"), ((F.col("id") + base) * 86400).alias("session_open_t"),
    )


def bar_grid(calendar: DataFrame, minutes: int) -> DataFrame:
    """Expected bar ends: whole bars within a segment, minutes counted from the session's open."""
    if minutes <= 0:
        raise ValueError("minutes is positive")
    width = minutes * 60
    return (
        calendar.where(f"close_t - open_t >= {width}")
        .select("session", "ordinal", "session_open_t", F.explode(F.expr(f"sequence(open_t + {width}, close_t, {width}L)")).alias("t"))
        .select("t", "session", F.col("ordinal").alias("session_index"), F.expr(f"cast((t - {width} - session_open_t) div 60 as int)").alias("minute_of_session"))
    )


def filter_regular_hours(bars: DataFrame, grid: DataFrame, minutes: int, label: str = "end") -> DataFrame:
    """Bars whose end stands in the grid; the vendor's own label is kept."""
    shift = minutes * 60 if label == "start" else 0
    keyed = bars.withColumn("_t", F.col("t") + shift)
    return keyed.join(grid.select(F.col("t").alias("_t")), "_t", "left_semi").drop("_t")


def attach_sessions(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """Bars with the grid's session columns; unmatched bars keep nulls for the caller to reject."""
    return bars.join(grid, "t", "left")
