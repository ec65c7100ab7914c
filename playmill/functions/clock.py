"""Game clocks, seasons and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playmill.functions.text import whole


def clock_seconds(clock: Column) -> Column:
    """Seconds of ``MM:SS`` or ``H:MM:SS`` by its last two fields; 0 where it cannot be read."""
    parts = F.split(clock, ":")
    value = whole(F.element_at(parts, -1)) + F.lit(60) * whole(F.element_at(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), -1))
    return F.when(F.size(parts) >= 2, F.coalesce(value, F.lit(0))).otherwise(F.lit(0))


def short_clock(clock: Column) -> Column:
    """``0:MM:SS`` as ``MM:SS``; other texts stay."""
    parts = F.split(clock, ":")
    return F.when(F.size(parts) == 3, F.concat_ws(":", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))).otherwise(clock)


def game_seconds_left(period: Column, clock: Column, periods: int = 4, minutes: int = 12) -> Column:
    """Seconds left in regulation; overtime counts its own clock only."""
    return clock_seconds(clock) + F.greatest(F.lit(periods) - period, F.lit(0)) * F.lit(60 * minutes)


def period_name(period: Column, periods: int = 4) -> Column:
    """Q1 to Q4, then OT, OT2, ..."""
    return F.when(period <= periods, F.concat(F.lit("Q"), period.cast("string"))).when(period == periods + 1, F.lit("OT")).otherwise(F.concat(F.lit("OT"), (period - periods).cast("string")))


def valid_clock(clock: Column, minutes: int = 12) -> Column:
    """Whether a text is a clock within a period."""
    m, s = (F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", i).try_cast("int") for i in (1, 2))
    return F.coalesce(clock.rlike(r"^\d{1,2}:\d{2}$") & m.between(0, minutes) & s.between(0, 59), F.lit(False))


def prior_season(season: Column) -> Column:
    """``2023-2024`` becomes ``2022-2023``; null where the text is no season."""
    first, second = (F.regexp_extract(season, r"^(\d{4})-(\d{4})$", i).try_cast("int") for i in (1, 2))
    return F.when(second == first + 1, F.format_string("%d-%d", first - 1, second - 1))


def every_days(first: Column, last: Column, days: int) -> Column:
    """Array of dates from first to last, ``days`` apart."""
    return F.sequence(first, last, F.expr(f"interval {days} days"))


def mixed_date(text: Column) -> Column:
    """A date written as month/day/year or year-month-day."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("M/d/yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")
