"""Sun position and what follows from it, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import D, clamp, col, half_up

_TILT = math.radians(23.4397)
_PERIHELION = math.radians(102.9372)


def days_since_2000(ts: D) -> Column:
    return F.unix_micros(col(ts)) / 86_400_000_000.0 - 10957.5


def _declination_and_ascension(d: Column) -> tuple[Column, Column]:
    anomaly = F.radians(357.5291 + 0.98560028 * d)
    centre = F.radians(1.9148 * F.sin(anomaly) + 0.02 * F.sin(2 * anomaly) + 0.0003 * F.sin(3 * anomaly))
    longitude = anomaly + centre + _PERIHELION + math.pi
    declination = F.asin(clamp(math.sin(_TILT) * F.sin(longitude), -1.0, 1.0))
    return declination, F.atan2(F.sin(longitude) * math.cos(_TILT), F.cos(longitude))


def normal_azimuth(c: D) -> Column:
    """Degrees from south to degrees from north in [0, 360)."""
    return F.pmod(col(c) + 180.0, F.lit(360.0))


def sun_position(ts: D, lat: D | float, lon: D | float) -> Column:
    """struct<azimuth, altitude> in degrees, azimuth clockwise from north; low-precision solar formulas."""
    d = days_since_2000(ts)
    declination, ascension = _declination_and_ascension(d)
    phi = F.radians(col(lat))
    hour = F.radians(280.16 + 360.9856235 * d) + F.radians(col(lon)) - ascension
    altitude = F.asin(clamp(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour), -1.0, 1.0))
    azimuth = F.atan2(F.sin(hour), F.cos(hour) * F.sin(phi) - F.tan(declination) * F.cos(phi))
    return F.struct(normal_azimuth(F.degrees(azimuth)).alias("azimuth"), F.degrees(altitude).alias("altitude"))


def sunrise_and_sunset(day: D, lat: D | float, lon: D | float, altitude: float = -0.833) -> Column:
    """struct<sunrise, sunset> (timestamps) of the day around the given instant, from its transit and hour angle.

    Null where the sun does not cross that altitude.
    """
    d = days_since_2000(day)
    west = -F.radians(col(lon))
    cycle = F.floor(d - 0.0009 - west / (2 * math.pi) + 0.5)

    def transit(angle: Column | float) -> Column:
        return 0.0009 + (angle + west) / (2 * math.pi) + cycle

    def refined(t: Column, at: Column) -> Column:
        anomaly = F.radians(357.5291 + 0.98560028 * at)
        centre = F.radians(1.9148 * F.sin(anomaly) + 0.02 * F.sin(2 * anomaly) + 0.0003 * F.sin(3 * anomaly))
        return t + 0.0053 * F.sin(anomaly) - 0.0069 * F.sin(2 * (anomaly + centre + _PERIHELION + math.pi))

    noon_at = transit(F.lit(0.0))
    noon = refined(noon_at, noon_at)
    declination, _ = _declination_and_ascension(noon_at)
    phi = F.radians(col(lat))
    cosine = (math.sin(math.radians(altitude)) - F.sin(phi) * F.sin(declination)) / (F.cos(phi) * F.cos(declination))
    angle = F.when(F.abs(cosine) <= 1, F.acos(clamp(cosine, -1.0, 1.0)))
    down = refined(transit(angle), noon_at)

    def instant(t: Column) -> Column:
        return F.timestamp_micros(F.floor((t + 10957.5) * 86_400_000_000.0 / 1000 + 0.5).cast("bigint") * 1000)

    return F.struct(instant(2 * noon - down).alias("sunrise"), instant(down).alias("sunset"))


def bucket(c: D, resolution: float) -> Column:
    """Number of the angle bucket whose centre is nearest below: floor(angle / resolution)."""
    return F.floor(col(c) / resolution).cast("int")


def bucket_key(azimuth_bucket: D, altitude_bucket: D) -> Column:
    """Both bucket numbers in one 32-bit key."""
    return F.shiftleft(col(altitude_bucket).cast("bigint"), 16).bitwiseOR(col(azimuth_bucket).cast("bigint"))


def azimuth_bin(c: D) -> Column:
    """Whole degree of a 360-bin horizon profile."""
    return F.pmod(half_up(c), F.lit(360.0)).cast("int")


def shadow_length(height: D, altitude: D) -> Column:
    """Length of the shadow that an object of this height throws; infinite where the sun is not above the horizon."""
    tangent = F.tan(F.radians(col(altitude)))
    return F.when(tangent <= 0, F.lit(float("inf"))).otherwise(col(height) / tangent)


def verdict(above: Column, horizon: Column, terrain: Column, buildings: Column, vegetation: Column, all_blockers: bool = False) -> Column:
    """struct<terrain_blocked, buildings_blocked, vegetation_blocked, is_sunny> in the order in which blockers are tried.

    Relief hides what stands in front of it: where the horizon or the local
    terrain blocks, buildings and vegetation are not evaluated (false), unless
    all_blockers is set. Below the horizon nothing is evaluated.
    """
    relief = above & (horizon | terrain)
    open_ = above if all_blockers else above & ~relief
    built = F.when(open_, buildings).otherwise(False)
    green = F.when(open_, vegetation).otherwise(False)
    return F.struct(
        relief.alias("terrain_blocked"), built.alias("buildings_blocked"), green.alias("vegetation_blocked"), (above & ~relief & ~built & ~green).alias("is_sunny")
    )
