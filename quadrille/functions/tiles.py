"""Web-Mercator tiles as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Web-Mercator sphere's radius, the tile's width in pixels and the deepest level.
RADIUS, PIXELS, DEEPEST = 6378137.0, 256, 20


def _side(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def tile_lon(z: Column, x: Column) -> Column:
    return x / _side(z) * 360 - 180


def tile_lat(z: Column, y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / _side(z)))))


def tile_bbox(z: Column, x: Column, y: Column) -> Column:
    return F.struct(tile_lon(z, x).alias("west"), tile_lat(z, y + 1).alias("south"), tile_lon(z, x + 1).alias("east"), tile_lat(z, y).alias("north"))


def ground_resolution(z: Column, y: Column) -> Column:
    """Metres per pixel at the tile's middle latitude."""
    middle = (tile_lat(z, y) + tile_lat(z, y + 1)) / 2
    return 2 * math.pi * RADIUS / (_side(z) * PIXELS) * F.cos(F.radians(middle))


def tile_x(z: Column, lon: Column) -> Column:
    return F.floor((lon + 180) / 360 * _side(z)).cast("long")


def tile_y(z: Column, lat: Column) -> Column:
    r = F.radians(lat)
    return F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * _side(z)).cast("long")


def tile_bbox_3857(z: Column, x: Column, y: Column) -> Column:
    edge, size = math.pi * RADIUS, 2 * math.pi * RADIUS / _side(z)
    return F.struct((x * size - edge).alias("west"), (edge - (y + 1) * size).alias("south"), ((x + 1) * size - edge).alias("east"), (edge - y * size).alias("north"))


def in_range(z: Column, x: Column, y: Column) -> Column:
    return z.between(0, DEEPEST) & (x >= 0) & (y >= 0) & (x < _side(z)) & (y < _side(z))


def viewport_area(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Square kilometres of a small box, on a sphere of 6371 km."""
    return 6371.0 * F.radians(east - west) * F.cos(F.radians((south + north) / 2)) * 6371.0 * F.radians(north - south)
