"""Geometry on columns: local metres, distances, bearings, text forms of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres per degree, the sphere's radius, the fallback origin.
LAT_M, LON_M, EARTH_M = 111_132.0, 111_320.0, 6_371_000.0
ORIGIN_LAT, ORIGIN_LON = 55.75, 37.6


def lon_scale(lat0: Column) -> Column:
    return LON_M * F.cos(F.radians(lat0))


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres north and east of an origin, in this order."""
    return (lat - lat0) * LAT_M, (lon - lon0) * lon_scale(lat0)


def planar_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat0: Column) -> Column:
    """Distance on the plane that touches at lat0."""
    return F.hypot((lat1 - lat2) * LAT_M, (lon1 - lon2) * lon_scale(lat0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction from the first point to the second, clockwise from north, in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Shortest signed turn from a to b, in [-180, 180)."""
    return F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0


def valid_heading(deg: Column) -> Column:
    return F.when((deg >= 0) & (deg < 360), deg)


def wkt_lon(geom: Column) -> Column:
    return F.regexp_extract(geom, r"POINT \(([-0-9.eE+]+) ([-0-9.eE+]+)\)", 1).try_cast("double")


def wkt_lat(geom: Column) -> Column:
    return F.regexp_extract(geom, r"POINT \(([-0-9.eE+]+) ([-0-9.eE+]+)\)", 2).try_cast("double")


def stop_key(lat: Column, lon: Column) -> Column:
    """Physical stop: both coordinates to five places; nan_nan if either is missing."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.5f_%.5f", lat, lon)).otherwise("nan_nan")


def in_world(lat: Column, lon: Column) -> Column:
    """Finite coordinates within +-90 and +-180 degrees."""
    return F.coalesce(F.abs(lat).between(0, 90) & F.abs(lon).between(0, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def bbox_key(south: Column, west: Column, north: Column, east: Column) -> Column:
    """A file-name form of a bounding box: four places, p for the point, m for minus."""
    part = lambda c: F.translate(F.format_string("%.4f", F.bround(c, 4)), ".-", "_m")
    return F.concat_ws("_", *(part(c) for c in (south, west, north, east)))
