"""Spherical geometry and longitude expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean sphere radius, and metres per degree on the velocity sphere.
EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = 111120.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the square-root argument is clamped to [0, 1]."""
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2)))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def haversine_text(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """C1 as SQL text, for use inside larger expressions and lambdas."""
    a = (f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"({2 * EARTH_RADIUS_KM!r}D * asin(sqrt(least(1D, greatest(0D, {a})))))"


def normalize_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180); values already inside keep their exact float."""
    wrapped = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return F.when((lon >= -180) & (lon < 180), lon + F.lit(0.0)).otherwise(wrapped)


def longitude_on_axis(lon: Column, west: Column, east: Column) -> Column:
    """Shift by whole turns to the copy nearest the middle of an axis."""
    middle = (west + east) / 2
    return lon + 360.0 * F.floor((middle - lon) / 360.0 + 0.5)


def unwrap_longitude(lon: Column, west: Column) -> Column:
    """Longitude counted eastward from ``west``."""
    return west + F.pmod(lon - west, F.lit(360.0))


def minus_360_from_180(lon: Column) -> Column:
    """Move [180, 360] to the western half; floats already in range stay untouched."""
    return F.when(lon >= 180, lon - 360.0).otherwise(lon)


def cosine_degrees(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def step_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Mid-latitude length of one short step."""
    dx = (lon2 - lon1) * cosine_degrees((lat1 + lat2) * 0.5)
    dy = lat2 - lat1
    return F.sqrt(dx * dx + dy * dy) * F.lit(METRES_PER_DEGREE / 1000.0)
