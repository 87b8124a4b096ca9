"""Local times of a zone and UTC, with the two-step offset rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import D, col


def _offset(at: Column, zone: D) -> Column:
    """Seconds by which the zone is ahead of UTC at the instant (microseconds since 1970)."""
    instant = F.timestamp_micros(at)
    local = F.from_utc_timestamp(instant, zone if isinstance(zone, str) else zone)
    return F.unix_micros(local) - F.unix_micros(instant)


def to_utc(local: D, zone: str) -> Column:
    """The instant of a local wall-clock time (a timestamp read as if it were UTC).

    The zone's offset is taken at the time itself, then once more at the result.
    Times that a change of clocks skips or repeats are resolved by that rule.
    """
    guess = F.unix_micros(col(local))
    first = _offset(guess, zone)
    second = _offset(guess - first, zone)
    return F.timestamp_micros(guess - second)


def local_text(instant: D, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(col(instant), zone), "yyyy-MM-dd HH:mm:ss")


def day_range(day: D, zone: str) -> Column:
    """struct<start, end>: the instants of a local date's midnight and the next one's (23, 24 or 25 hours)."""
    midnight = col(day).cast("timestamp")
    return F.struct(to_utc(midnight, zone).alias("start"), to_utc(F.date_add(col(day), 1).cast("timestamp"), zone).alias("end"))
