"""Geodesy, Web Mercator and tiles as column expressions. Degrees unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the projection.
EARTH_RADIUS_KM = 6378.137
MAX_LATITUDE = 85.05112877980659
TILE_SIZE = 4096
#: Padé [11/11] of the inverse Gudermannian in degrees for |latitude| <= 70, highest power first.
PADE_NUMERATOR = (-9.829380759917322e-23, 2.090142250253142e-23, 3.135247548180731e-17, -2.2456381083177667e-18, -1.772744532357163e-12, 6.311927023204925e-14, 3.6818805547030475e-8, -6.627785084960899e-10, -3.212917016733647e-4, 2.344394103869972e-6, 1.000000000000891, 0.0)
PADE_DENOMINATOR = (-3.230832248359674e-28, -8.721307289820124e-22, 9.17695141954266e-23, 9.329992291691568e-17, -4.784462798887749e-18, -3.308332886079218e-12, 9.374685611980987e-14, 5.184187241865764e-8, -7.818023896854292e-10, -3.7206127162725197e-4, 2.344394103989707e-6, 1.0)


def degrees(micro: Column) -> Column:
    """Degrees of a fixed-point coordinate (micro-degrees)."""
    return micro / F.lit(1e6)


def fixed_point(degree: Column) -> Column:
    """Micro-degrees, cut toward zero and clamped to 32 bits."""
    return F.least(F.greatest(degree * 1e6, F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("int")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def vincenty(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres by Vincenty's formula on the sphere, stable for antipodes."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.abs(F.radians(lon1) - F.radians(lon2))
    up = F.sqrt(F.pow(F.cos(q) * F.sin(d), 2) + F.pow(F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d), 2))
    return F.lit(EARTH_RADIUS_KM) * F.atan2(up, F.sin(p) * F.sin(q) + F.cos(p) * F.cos(q) * F.cos(d))


def clamp_lat(lat: Column) -> Column:
    return F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE))


def clamp_lon(lon: Column) -> Column:
    return F.least(F.greatest(lon, F.lit(-180.0)), F.lit(180.0))


def lon_to_x(lon: Column) -> Column:
    """Metres east of Greenwich."""
    return lon * F.lit(EARTH_RADIUS_KM * 1000) * F.pi() / 180.0


def x_to_lon(x: Column) -> Column:
    return x * 180.0 / (F.lit(EARTH_RADIUS_KM * 1000) * F.pi())


def lat_to_y(lat: Column) -> Column:
    """The projected latitude, in degrees of the map's scale (not metres)."""
    f = F.sin(F.radians(clamp_lat(lat)))
    return F.degrees(F.lit(0.5)) * F.log((1 + f) / (1 - f))


def y_to_lat(y: Column) -> Column:
    bounded = F.least(F.greatest(y, F.lit(-180.0)), F.lit(180.0))
    return F.degrees(F.lit(2.0)) * F.atan(F.exp(F.radians(bounded))) - 90.0


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    """Horner's scheme, highest power first; 0 for none."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients, F.lit(0.0))


def lat_to_y_approx(lat: Column) -> Column:
    """lat_to_y by a quotient of polynomials inside 70 degrees either way, exact outside."""
    return F.when(lat.between(-70.0, 70.0), polynomial(PADE_NUMERATOR, lat) / polynomial(PADE_DENOMINATOR, lat)).otherwise(lat_to_y(lat))


def pixel_x(lon: Column, zoom: int, tile_size: int = TILE_SIZE) -> Column:
    return F.lit((1 << zoom) * tile_size / 2.0) * (1.0 + lon / 180.0)


def pixel_y(lat: Column, zoom: int, tile_size: int = TILE_SIZE) -> Column:
    return F.lit((1 << zoom) * tile_size / 2.0) * (1.0 - lat_to_y(lat) / 180.0)


def pixel_to_lon(x: Column, size: float) -> Column:
    return (x - size / 2.0) / size * 360.0


def pixel_to_lat(y: Column, size: float) -> Column:
    return y_to_lat(F.degrees(F.pi() * (1.0 - 2.0 * (y / size))))


def _tile(part: Column) -> Column:
    return F.least(F.greatest(F.coalesce(part, F.lit(0.0)), F.lit(0.0)), F.lit(4294967295.0)).cast("long")


def tile_x(lon: Column, zoom: int) -> Column:
    return _tile(F.lit(float(1 << zoom)) * (lon + 180.0) / 360.0)


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(lat)
    return _tile(F.lit(float(1 << zoom)) * (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0)


def tile_west(x: Column, zoom: int) -> Column:
    return x / float(1 << zoom) * 360.0 - 180.0


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / float(1 << zoom)))))


def in_tile(lat: Column, lon: Column, zoom: int, x: Column, y: Column, tile_size: int = TILE_SIZE) -> tuple[Column, Column]:
    """Coordinates inside a tile, 0 to tile_size - 1, measured from its west and north edges. Longitudes stay in degrees, as
    metres would put points that lie on a coordinate just before it; latitudes are projected exactly."""
    west, east = tile_west(x, zoom), tile_west(x + 1, zoom)
    north, south = lat_to_y(tile_north(y, zoom)), lat_to_y(tile_north(y + 1, zoom))
    cut = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(tile_size - 1.0)).cast("long")
    return cut((lon - west) * (tile_size - 1.0) / (east - west)), cut((lat_to_y(lat) - north) * (tile_size - 1.0) / (south - north))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(distance, x, y): the distance of a point to a segment and the closest point on it."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / size, F.lit(0.0)), F.lit(1.0)))
    x, y = ax + t * dx, ay + t * dy
    return F.struct(F.sqrt(F.pow(px - x, 2) + F.pow(py - y, 2)).alias("distance"), x.alias("x"), y.alias("y"))


def cross_product(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cross product of (a - o) and (b - o) in 64-bit integers; positive for a left turn."""
    wide = [c.cast("long") for c in (ox, oy, ax, ay, bx, by)]
    return (wide[2] - wide[0]) * (wide[5] - wide[1]) - (wide[3] - wide[1]) * (wide[4] - wide[0])


def euclidean_2d(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance rounded to the nearest integer."""
    dx, dy = x1.cast("long") - x2.cast("long"), y1.cast("long") - y2.cast("long")
    return F.round(F.sqrt(dx * dx + dy * dy)).cast("long")


def zorder_key(lat: Column, lon: Column) -> Column:
    """A signed 64-bit key in Z-order of two 32-bit coordinates: latitude bits above longitude bits."""
    # Spread each half by doubling gaps; signs are flipped so that unsigned order becomes signed order.
    def spread(v: Column) -> Column:
        v = v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    west = spread(lon.cast("long").bitwiseXOR(F.lit(0x80000000)))
    return F.shiftleft(spread(lat.cast("long")), 1).bitwiseOR(west)
