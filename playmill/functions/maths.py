"""Ratios, coordinates, odds and stakes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or ``default`` where b is 0 or either is null."""
    out = F.try_divide(a, b)
    return out if default is None else F.coalesce(out, F.lit(default))


def score_delta(away: Column, home: Column, before_away: Column, before_home: Column) -> Column:
    """Points a play added, never below 0."""
    return F.greatest(F.lit(0), away - before_away, home - before_home)


def half_court(x: Column, y: Column) -> Column:
    """struct(x, y): the far half mirrored onto the near one, one decimal; null outside the court."""
    far = y > 47
    fx, fy = F.when(far, F.lit(50) - x).otherwise(x), F.when(far, y - F.lit(47)).otherwise(y)
    return F.when(fx.between(0, 50) & fy.between(0, 47), F.struct(F.round(fx, 1).alias("x"), F.round(fy, 1).alias("y")))


def moneyline(text: Column) -> Column:
    """American odds as a number: signed or unsigned digits, else null."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^[+-]?\d+(\.\d+)?$"), F.regexp_replace(t, r"^\+", "").try_cast("double"))


def implied_probability(text: Column) -> Column:
    """The probability that odds imply; null where they cannot be read or are 0."""
    m = moneyline(text)
    return F.when(m > 0, F.lit(100.0) / (m + 100)).when(m < 0, -m / (-m + 100))


def kelly_fraction(probability: Column, text: Column, cap: float = 0.25) -> Column:
    """The Kelly share of the bankroll, between 0 and ``cap``; 0 where the odds cannot be read."""
    m = moneyline(text)
    gain = F.when(m > 0, m / 100).when(m < 0, F.lit(100.0) / -m)
    share = F.try_divide(gain * probability - (F.lit(1.0) - probability), gain)
    return F.coalesce(F.least(F.lit(cap), F.greatest(F.lit(0.0), share)), F.lit(0.0))


def scoring_class(points: Column) -> Column:
    """What a play scored.  Fixed values: the five names."""
    return F.when(points == 1, "Free Throw").when(points == 2, "2-Point Field Goal").when(points == 3, "3-Point Field Goal").when(points > 3, "Multiple Scoring Plays").otherwise("No Score")


def leader(away: Column, home: Column, away_team: Column, home_team: Column) -> Column:
    """The team ahead, or TIE."""
    return F.when(away > home, away_team).when(home > away, home_team).otherwise("TIE")


def pseudo_score(name: Column, shift: int, low: float, high: float) -> Column:
    """A repeatable number in [low, high] from the first eight hex digits of md5."""
    bits = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")
    return F.lit(low) + F.pmod(F.shiftright(bits, shift), F.lit(1000)) / F.lit(999.0) * F.lit(high - low)


def hundredths(x: Column) -> Column:
    """The number as an integer of hundredths, halves to even."""
    return F.bround(x * 100).cast("int")


def backoff(attempt: Column, base: float, cap: float) -> Column:
    """Exponential wait without jitter."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))
