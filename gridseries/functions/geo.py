"""Distances on the globe and cells to find near points by."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere: no date line, no poles, and near means near in all three coordinates."""
    flat = F.cos(F.radians(lat))
    return flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def chord(km: Column) -> Column:
    """Straight-line length on the unit sphere of a great-circle distance."""
    return F.sin(F.least(km / (2 * EARTH_RADIUS_KM), F.lit(math.pi / 2))) * 2


def cube(lat: Column, lon: Column, size: Column) -> list[Column]:
    """Integer coordinates of the cube of edge `size` that holds the point."""
    return [F.floor(c / size).cast("long") for c in unit_vector(lat, lon)]


def around(cell: Column, reach: int) -> Column:
    """Array of the cell numbers from `cell` - reach to `cell` + reach."""
    return F.sequence(cell - reach, cell + reach)
