"""Coordinates: the Swiss plane, offsets, boxes and distances, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import D, col

METRES_PER_DEGREE = 111_320.0
EARTH_RADIUS = 6_371_000.0

# Fixed values of the Swiss survey's published transformation: ellipsoids, origin, translation.
BESSEL_A, BESSEL_E2 = 6377397.155, 0.006674372230614
WGS_A, WGS_E2 = 6378137.0, 0.00669437999014
ORIGIN_LON, ORIGIN_LAT = math.radians(7 + 26 / 60 + 22.5 / 3600), math.radians(46 + 57 / 60 + 8.66 / 3600)
SHIFT = (674.374, 15.056, 405.346)
FALSE_E, FALSE_N = 2_600_000.0, 1_200_000.0

E = math.sqrt(BESSEL_E2)
SPHERE_R = BESSEL_A * math.sqrt(1 - BESSEL_E2) / (1 - BESSEL_E2 * math.sin(ORIGIN_LAT) ** 2)
ALPHA = math.sqrt(1 + BESSEL_E2 / (1 - BESSEL_E2) * math.cos(ORIGIN_LAT) ** 4)
B0 = math.asin(math.sin(ORIGIN_LAT) / ALPHA)


def _isometric(phi: float) -> float:
    return math.log(math.tan(math.pi / 4 + phi / 2)) - E / 2 * math.log((1 + E * math.sin(phi)) / (1 - E * math.sin(phi)))


K = math.log(math.tan(math.pi / 4 + B0 / 2)) - ALPHA * _isometric(ORIGIN_LAT)


def _geodetic(x: Column, y: Column, z: Column, a: float, e2: float) -> tuple[Column, Column]:
    """Longitude and latitude on an ellipsoid; Bowring's closed form, well below a millimetre near the ground."""
    b = a * math.sqrt(1 - e2)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * a, p * b)
    return F.atan2(y, x), F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(theta), 3), p - e2 * a * F.pow(F.cos(theta), 3))


def _geocentric(lon: Column, lat: Column, a: float, e2: float) -> tuple[Column, Column, Column]:
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1 - e2) * F.sin(lat)


def to_plane(lon: D, lat: D) -> Column:
    """struct<e, n>: WGS84 degrees to the Swiss plane (CH1903+), rigorous."""
    x, y, z = _geocentric(F.radians(col(lon)), F.radians(col(lat)), WGS_A, WGS_E2)
    lam, phi = _geodetic(x - SHIFT[0], y - SHIFT[1], z - SHIFT[2], BESSEL_A, BESSEL_E2)
    s = F.log(F.tan(math.pi / 4 + phi / 2)) - E / 2 * F.log((1 + E * F.sin(phi)) / (1 - E * F.sin(phi)))
    b = 2 * F.atan(F.exp(K + ALPHA * s)) - math.pi / 2
    turn = (lam - ORIGIN_LON) * ALPHA
    b_ = F.asin(math.cos(B0) * F.sin(b) - math.sin(B0) * F.cos(b) * F.cos(turn))
    l_ = F.atan2(F.cos(b) * F.sin(turn), math.sin(B0) * F.sin(b) + math.cos(B0) * F.cos(b) * F.cos(turn))
    return F.struct(
        (FALSE_E + SPHERE_R * l_).alias("e"), (FALSE_N + SPHERE_R * F.log(F.tan(math.pi / 4 + b_ / 2))).alias("n")
    )


def to_wgs84(e: D, n: D) -> Column:
    """struct<lon, lat>: the Swiss plane to WGS84 degrees, rigorous (latitude by six fixed-point steps)."""
    l_ = (col(e) - FALSE_E) / SPHERE_R
    b_ = 2 * (F.atan(F.exp((col(n) - FALSE_N) / SPHERE_R)) - math.pi / 4)
    b = F.asin(math.cos(B0) * F.sin(b_) + math.sin(B0) * F.cos(b_) * F.cos(l_))
    turn = F.atan2(F.sin(l_), math.cos(B0) * F.cos(l_) - math.sin(B0) * F.tan(b_))
    s = (F.log(F.tan(math.pi / 4 + b / 2)) - K) / ALPHA
    phi = b
    for _ in range(6):
        phi = 2 * F.atan(F.exp(s + E * F.log(F.tan(math.pi / 4 + F.asin(E * F.sin(phi)) / 2)))) - math.pi / 2
    x, y, z = _geocentric(ORIGIN_LON + turn / ALPHA, phi, BESSEL_A, BESSEL_E2)
    lon, lat = _geodetic(x + SHIFT[0], y + SHIFT[1], z + SHIFT[2], WGS_A, WGS_E2)
    return F.struct(F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))


def to_wgs84_fast(e: D, n: D) -> Column:
    """struct<lon, lat>: the survey's polynomial approximation, good to about two metres. (Coefficients are fixed values.)"""
    y, x = (col(e) - FALSE_E) / 1e6, (col(n) - FALSE_N) / 1e6
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return F.struct((lon * 100 / 36).alias("lon"), (lat * 100 / 36).alias("lat"))


def offset(lat: D, lon: D, metres: D | float, bearing: D | float) -> Column:
    """struct<lat, lon> of the point so far away in that direction, on a locally flat earth."""
    per_lon = METRES_PER_DEGREE * F.greatest(F.cos(F.radians(col(lat))), F.lit(0.01))
    turn = F.radians(col(bearing))
    return F.struct(
        (col(lat) + F.cos(turn) * col(metres) / METRES_PER_DEGREE).alias("lat"), (col(lon) + F.sin(turn) * col(metres) / per_lon).alias("lon")
    )


def destination(lat: D, lon: D, bearing: D | float, metres: D | float) -> Column:
    """struct<lat, lon> on the great circle, longitude in [-180, 180]."""
    phi, lam, turn, arc = F.radians(col(lat)), F.radians(col(lon)), F.radians(col(bearing)), col(metres) / EARTH_RADIUS
    to = F.asin(F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(turn))
    east = lam + F.atan2(F.sin(turn) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * F.sin(to))
    degrees = F.degrees(east)
    wrapped = F.when(degrees > 180, degrees - 360).when(degrees < -180, degrees + 360).otherwise(degrees)
    return F.struct(F.degrees(to).alias("lat"), wrapped.alias("lon"))


def haversine(lat1: D, lon1: D, lat2: D, lon2: D) -> Column:
    dphi, dlam = F.radians(col(lat2) - col(lat1)) / 2, F.radians(col(lon2) - col(lon1)) / 2
    h = F.pow(F.sin(dphi), 2) + F.cos(F.radians(col(lat1))) * F.cos(F.radians(col(lat2))) * F.pow(F.sin(dlam), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def box_around(lon: D, lat: D, km: D | float) -> Column:
    """struct<min_lon, min_lat, max_lon, max_lat> of a radius in kilometres."""
    dlat = col(km) / 111.32
    dlon = col(km) / (111.32 * F.greatest(F.cos(F.radians(col(lat))), F.lit(0.01)))
    return F.struct((col(lon) - dlon).alias("min_lon"), (col(lat) - dlat).alias("min_lat"), (col(lon) + dlon).alias("max_lon"), (col(lat) + dlat).alias("max_lat"))


def in_box(lon: D, lat: D, box: str = "") -> Column:
    """The point lies in the box, edges included; box prefixes min_lon, min_lat, max_lon, max_lat."""
    return col(lon).between(F.col(f"{box}min_lon"), F.col(f"{box}max_lon")) & col(lat).between(F.col(f"{box}min_lat"), F.col(f"{box}max_lat"))


def boxes_meet(a: str, b: str) -> Column:
    return (
        (F.col(f"{a}min_lon") <= F.col(f"{b}max_lon")) & (F.col(f"{a}max_lon") >= F.col(f"{b}min_lon"))
        & (F.col(f"{a}min_lat") <= F.col(f"{b}max_lat")) & (F.col(f"{a}max_lat") >= F.col(f"{b}min_lat"))
    )


def box_contains(a: str, b: str) -> Column:
    """Box a contains all of box b."""
    return (
        (F.col(f"{a}min_lon") <= F.col(f"{b}min_lon")) & (F.col(f"{a}max_lon") >= F.col(f"{b}max_lon"))
        & (F.col(f"{a}min_lat") <= F.col(f"{b}min_lat")) & (F.col(f"{a}max_lat") >= F.col(f"{b}max_lat"))
    )


def overlap_area(a: str, b: str) -> Column:
    def side(axis: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(f"{a}max_{axis}", f"{b}max_{axis}") - F.greatest(f"{a}min_{axis}", f"{b}min_{axis}"))

    return side("lon") * side("lat")


def metres_per_pixel(lat: D, zoom: D) -> Column:
    """Ground size of a 256-pixel web map's pixel."""
    return 156543.03392804097 * F.cos(F.radians(col(lat))) / F.pow(F.lit(2.0), col(zoom))


def bi_affine(u: D, v: D, nw: D, ne: D, sw: D, se: D) -> Column:
    """Value at (u, v) in [0, 1]^2 between four corners, u eastward, v southward."""
    u, v = col(u), col(v)
    return (1 - u) * (1 - v) * col(nw) + u * (1 - v) * col(ne) + (1 - u) * v * col(sw) + u * v * col(se)
