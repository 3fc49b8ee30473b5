"""Boxes as structs (min_lat, min_lon, max_lat, max_lon) in micro-degrees, and the metrics that searches measure in.

A metric is a strategy object: ``distance`` of two points and ``min_distance`` of a box and a point, as expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadloom.functions.geo import degrees, haversine

SIDES = ("min_lat", "min_lon", "max_lat", "max_lon")


def box(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    return F.struct(*(c.cast("long").alias(n) for c, n in zip((min_lat, min_lon, max_lat, max_lon), SIDES, strict=True)))


def point_box(lat: Column, lon: Column) -> Column:
    """The box that holds one point."""
    return box(lat, lon, lat, lon)


def is_valid(b: Column) -> Column:
    return (b["min_lat"] <= b["max_lat"]) & (b["min_lon"] <= b["max_lon"])


def contains(b: Column, lat: Column, lon: Column) -> Column:
    """Whether a point lies in the box or on its border."""
    return lat.between(b["min_lat"], b["max_lat"]) & lon.between(b["min_lon"], b["max_lon"])


def intersects(a: Column, b: Column) -> Column:
    """Whether two boxes share a point; touching is enough."""
    return (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"]) & (a["min_lon"] <= b["max_lon"]) & (b["min_lon"] <= a["max_lon"])


def merged(a: Column, b: Column) -> Column:
    """The smallest box around both."""
    return box(F.least(a["min_lat"], b["min_lat"]), F.least(a["min_lon"], b["min_lon"]), F.greatest(a["max_lat"], b["max_lat"]), F.greatest(a["max_lon"], b["max_lon"]))


def center(b: Column) -> tuple[Column, Column]:
    """(lat, lon) of the middle; halves of odd lengths are cut off."""
    half = lambda low, high: (b[low] + F.floor((b[high] - b[low]) / 2)).cast("long")
    return half("min_lat", "max_lat"), half("min_lon", "max_lon")


def nearest_point(b: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(lat, lon) of the point of the box that is nearest axis by axis."""
    cut = lambda v, low, high: F.least(F.greatest(v.cast("long"), b[low]), b[high])
    return cut(lat, "min_lat", "max_lat"), cut(lon, "min_lon", "max_lon")


def geojson_bbox(b: Column) -> Column:
    """[west, south, east, north] in degrees."""
    return F.array(*(degrees(b[c]) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))


def lon_lat(lat: Column, lon: Column) -> Column:
    """[longitude, latitude] in degrees."""
    return F.array(degrees(lon), degrees(lat))


def display(lat: Column, lon: Column) -> Column:
    """"latitude, longitude" in degrees with six decimals."""
    return F.format_string("%.6f, %.6f", degrees(lat), degrees(lon))


class Haversine:
    """Great-circle kilometres."""

    @staticmethod
    def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
        return haversine(degrees(lat1), degrees(lon1), degrees(lat2), degrees(lon2))

    @staticmethod
    def min_distance(b: Column, lat: Column, lon: Column) -> Column:
        """0 inside; else to the nearest point axis by axis, which near the poles and across the antimeridian may be
        farther than the nearest point on the sphere, so it orders boxes but must not discard any."""
        return F.when(contains(b, lat, lon), F.lit(0.0)).otherwise(Haversine.distance(*nearest_point(b, lat, lon), lat, lon))


class Planar:
    """Straight lines over micro-degrees taken as a plane."""

    @staticmethod
    def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
        a, b = (lat1 - lat2).cast("double"), (lon1 - lon2).cast("double")
        return F.sqrt(a * a + b * b)

    @staticmethod
    def min_distance(b: Column, lat: Column, lon: Column) -> Column:
        return Planar.distance(*nearest_point(b, lat, lon), lat, lon)
