"""Tile pyramid maths as Column expressions (spherical Mercator, y down)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latitude at which the square Mercator world ends.
MAX_LATITUDE = 85.0511287
#: Radius of the spherical Mercator projection, metres.
MERCATOR_RADIUS = 6378137.0
EXTENT = 4096
NEAR_POLE = 89.9999997


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _number(x) -> Column:
    """least and greatest pass over nulls, so a null or NaN coordinate is sorted out first."""
    return _c(x).isNotNull() & ~F.isnan(_c(x).cast("double"))


def tile_count(zoom) -> Column:
    """Tiles along one side at this zoom."""
    return F.pow(F.lit(2.0), _c(zoom))


def tile_x(lon, zoom) -> Column:
    n = tile_count(zoom)
    column = F.greatest(F.lit(0), F.least(F.floor((_c(lon) + 180.0) / 360.0 * n), n - 1)).cast("int")
    return F.when(_number(lon), column)


def tile_y(lat, zoom) -> Column:
    n = tile_count(zoom)
    phi = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(_c(lat), F.lit(MAX_LATITUDE))))
    row = (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n
    return F.when(_number(lat), F.greatest(F.lit(0), F.least(F.floor(row), n - 1)).cast("int"))


def tile_name(lon, lat, zoom) -> Column:
    """``z/x/y`` of the tile that holds the point; null if a coordinate is null."""
    return tile_text(zoom, tile_x(lon, zoom), tile_y(lat, zoom))


def tile_text(zoom, x, y) -> Column:
    z, x, y = (_c(v).cast("string") for v in (zoom, x, y))
    return F.concat(z, F.lit("/"), x, F.lit("/"), y)


def tile_west(x, zoom) -> Column:
    return _c(x) / tile_count(zoom) * 360.0 - 180.0


def tile_north(y, zoom) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2.0 * _c(y) / tile_count(zoom)))))


def tile_bbox(x, y, zoom) -> Column:
    """Struct minx, miny, maxx, maxy in degrees."""
    return F.struct(
        tile_west(x, zoom).alias("minx"), tile_north(_c(y) + 1, zoom).alias("miny"),
        tile_west(_c(x) + 1, zoom).alias("maxx"), tile_north(y, zoom).alias("maxy"),
    )


def resolution(zoom, extent=EXTENT) -> Column:
    """Degrees of longitude per unit of the tile's own grid."""
    return F.lit(360.0) / (tile_count(zoom) * _c(extent))


def mercator_x(lon) -> Column:
    return F.radians(_c(lon)) * MERCATOR_RADIUS


def mercator_y(lat) -> Column:
    """The poles, which lie at infinity, count as the last thousandth of a second before them."""
    near = F.greatest(F.lit(-NEAR_POLE), F.least(_c(lat), F.lit(NEAR_POLE)))
    return F.when(_c(lat).isNotNull(), F.ln(F.tan(F.lit(math.pi / 4) + F.radians(near) / 2)) * MERCATOR_RADIUS)


def latitude(my) -> Column:
    """Inverse of :func:`mercator_y`."""
    return F.degrees(2 * F.atan(F.exp(_c(my) / MERCATOR_RADIUS)) - math.pi / 2)


def tile_point(lon, lat, minx, miny, maxx, maxy, extent=EXTENT) -> Column:
    """Position in the grid of a box in degrees: x stays fractional, y is cut to an integer before it is turned downwards."""
    left, low, right, high = mercator_x(minx), mercator_y(miny), mercator_x(maxx), mercator_y(maxy)
    px = (mercator_x(lon) - left) / (right - left) * _c(extent)
    py = ((mercator_y(lat) - low) / (high - low) * _c(extent)).cast("bigint")
    return F.struct(px.alias("x"), (_c(extent) - py).cast("double").alias("y"))


def coverage(minx, miny, maxx, maxy, zoom) -> Column:
    """Array of struct x, y: every tile the box touches, by columns then rows; explode it."""
    xs = F.sequence(tile_x(minx, zoom), tile_x(maxx, zoom))
    ys = F.sequence(tile_y(maxy, zoom), tile_y(miny, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def coverage_size(minx, miny, maxx, maxy, zoom) -> Column:
    """How many tiles :func:`coverage` gives, without building them."""
    dx = tile_x(maxx, zoom) - tile_x(minx, zoom) + 1
    return dx.cast("bigint") * (tile_y(miny, zoom) - tile_y(maxy, zoom) + 1)
