"""Distances, grid cells and boxes as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
METRES_PER_DEGREE = 111320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("long")


def bbox_around(lat: Column, lon: Column, radius_m: Column) -> Column:
    """[south, north, west, east] around a point."""
    dlat = radius_m / METRES_PER_DEGREE
    dlon = radius_m / (F.lit(METRES_PER_DEGREE) * F.greatest(F.lit(0.01), F.cos(F.radians(lat))))
    return F.array(lat - dlat, lat + dlat, lon - dlon, lon + dlon)


def bbox_quadrants(south: Column, north: Column, west: Column, east: Column) -> Column:
    """The four equal quadrants, south-west first."""
    lat, lon = (south + north) / 2, (west + east) / 2
    box = lambda s, n, w, e: F.struct(s.alias("south"), n.alias("north"), w.alias("west"), e.alias("east"))
    return F.array(box(south, lat, west, lon), box(south, lat, lon, east), box(lat, north, west, lon), box(lat, north, lon, east))


def lon_reach(lat: Column, radius_m: float, size: float) -> Column:
    """Cells to look east and west so that no pair within the radius is missed at this latitude."""
    near = F.cos(F.radians(F.least(F.lit(89.0), F.abs(lat) + radius_m / METRES_PER_DEGREE)))
    return F.ceil(F.lit(radius_m / (METRES_PER_DEGREE * size)) / near).cast("int")


def lat_reach(radius_m: float, size: float) -> int:
    return math.ceil(radius_m / (METRES_PER_DEGREE * size))
