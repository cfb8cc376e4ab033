"""Distances, projections and rasters' cell arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LON_M, LAT_M, EARTH_KM = 111_320.0, 110_540.0, 6371.0
# Ellipsoids (a, 1/f) and datum shifts to WGS84 (ellipsoid, dx, dy, dz).
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "INTL24": (6378388.0, 297.0), "SA69": (6378160.0, 298.25)}
DATUMS = {"WGS84": ("WGS84", 0.0, 0.0, 0.0), "SIRGAS": ("GRS80", 0.0, 0.0, 0.0), "PSAD56": ("INTL24", -270.0, 188.0, -388.0), "PSAD56_NORTH": ("INTL24", -279.0, 175.0, -379.0), "SAD69": ("SA69", -59.0, -11.0, -52.0)}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres on the local plane at the first point."""
    return F.hypot((lon2 - lon1) * F.cos(F.radians(lat1)) * LON_M, (lat2 - lat1) * LAT_M)


def mercator_x(lon: Column, zoom: Column) -> Column:
    return (lon + 180) / 360 * F.pow(F.lit(2.0), zoom)


def mercator_y(lat: Column, zoom: Column) -> Column:
    r = F.radians(lat)
    return (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * F.pow(F.lit(2.0), zoom)


def mercator_lon(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360 - 180


def mercator_lat(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / F.pow(F.lit(2.0), zoom)))))


def utm_inverse(east: Column, north: Column, zone: Column, south: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """(lat, lon) in degrees by Snyder's series."""
    a, inv_f = ELLIPSOIDS[ellipsoid]
    f = 1 / inv_f
    e2 = f * (2 - f)
    ep2, k0 = e2 / (1 - e2), 0.9996
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    x = east - 500_000.0
    y = F.when(south, north - 10_000_000.0).otherwise(north)
    mu = y / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    c1, t1 = ep2 * F.pow(F.cos(phi), F.lit(2.0)), F.pow(F.tan(phi), F.lit(2.0))
    w = 1 - e2 * F.pow(F.sin(phi), F.lit(2.0))
    n1, r1 = a / F.sqrt(w), a * (1 - e2) / F.pow(w, F.lit(1.5))
    d = x / (n1 * k0)
    p = lambda k: F.pow(d, F.lit(float(k)))
    lat = phi - n1 * F.tan(phi) / r1 * (p(2) / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep2) * p(4) / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep2 - 3 * c1 * c1) * p(6) / 720)
    lon = (d - (1 + 2 * t1 + c1) * p(3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep2 + 24 * t1 * t1) * p(5) / 120) / F.cos(phi)
    return F.degrees(lat), F.degrees(lon) + zone * 6 - 183


def to_wgs84(lat: Column, lon: Column, datum: str) -> tuple[Column, Column]:
    """Three-parameter geocentric shift at height 0, back by Bowring's formula."""
    ellipsoid, dx, dy, dz = DATUMS[datum]
    if dx == dy == dz == 0:
        return lat, lon
    a, inv_f = ELLIPSOIDS[ellipsoid]
    e2 = (2 - 1 / inv_f) / inv_f
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = a / F.sqrt(1 - e2 * s * s)
    x, y, z = n * c * F.cos(F.radians(lon)) + dx, n * c * F.sin(F.radians(lon)) + dy, n * (1 - e2) * s + dz
    a, inv_f = ELLIPSOIDS["WGS84"]
    e2 = (2 - 1 / inv_f) / inv_f
    b = a * math.sqrt(1 - e2)
    p = F.hypot(x, y)
    theta = F.atan2(z * a, p * b)
    up = z + (a * a - b * b) / (b * b) * b * F.pow(F.sin(theta), F.lit(3.0))
    out = p - e2 * a * F.pow(F.cos(theta), F.lit(3.0))
    return F.degrees(F.atan2(up, out)), F.degrees(F.atan2(y, x))
