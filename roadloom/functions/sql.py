"""Functions for SQL: scalar functions as SQL expressions, which run in the JVM, and table functions in Python."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from roadloom.functions.geo import EARTH_RADIUS_KM, MAX_LATITUDE
from roadloom.session import ship

_HALF = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon1 - lon2) / 2), 2)"
_FOUR = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"
_SPREAD = "aggregate(sequence(0, 31), 0L, (a, i) -> a | shiftleft(cast(getbit({v}, i) AS bigint), 2 * i + {o}))"

#: name: (parameters, result, expression)
SCALARS = {
    "haversine_km": (_FOUR, "DOUBLE", f"{2 * EARTH_RADIUS_KM} * atan2(sqrt({_HALF}), sqrt(greatest(1 - ({_HALF}), 0.0D)))"),
    "mercator_x": ("lon DOUBLE", "DOUBLE", f"lon * {EARTH_RADIUS_KM * 1000} * pi() / 180"),
    "mercator_y": ("lat DOUBLE", "DOUBLE", f"degrees(0.5D) * ln((1 + sin(radians(greatest(least(lat, {MAX_LATITUDE}D), -{MAX_LATITUDE}D)))) / (1 - sin(radians(greatest(least(lat, {MAX_LATITUDE}D), -{MAX_LATITUDE}D)))))"),
    "tile_column": ("lon DOUBLE, zoom INT", "BIGINT", "cast(greatest(shiftleft(1L, zoom) * (lon + 180) / 360, 0.0D) AS bigint)"),
    "tile_row": ("lat DOUBLE, zoom INT", "BIGINT", "cast(greatest(shiftleft(1L, zoom) * (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2, 0.0D) AS bigint)"),
    "zorder": ("lat INT, lon INT", "BIGINT", f"{_SPREAD.format(v='cast(lat AS bigint) & 4294967295L', o=1)} | {_SPREAD.format(v='(cast(lon AS bigint) & 4294967295L) ^ 2147483648L', o=0)}"),
    "zigzag": ("v BIGINT", "BIGINT", "(shiftleft(v, 1) ^ shiftright(v, 63)) & 4294967295L"),
    "lowest_bit": ("n BIGINT", "BIGINT", "CASE WHEN n <> 0 THEN cast(bit_count((n & -n) - 1) AS bigint) END"),
    "prev_power_of_two": ("n BIGINT", "BIGINT", "CASE WHEN n = 0 THEN 0L ELSE shiftleft(1L, length(bin(n)) - 1) END"),
    "partition_parent": ("p BIGINT", "BIGINT", "greatest(shiftright(p, 1), 1L)"),
    "partition_level": ("p BIGINT", "BIGINT", "cast(length(bin(p)) - 1 AS bigint)"),
}


@udtf(returnType="subset bigint")
class BitSubsets:
    """The subsets of a bit mask of up to 62 bits, ascending from 0, the mask itself last."""

    def eval(self, mask: int) -> Iterator[tuple[int]]:
        x = 0
        while True:
            yield (x,)
            if x == mask:
                return
            x = (x - mask) & mask


@udtf(returnType="idx bigint, value bigint")
class WeightWords:
    """The 64-bit words (two's complement) with `weight` set bits, ascending as unsigned numbers, at most `most` of them."""

    def eval(self, weight: int, most: int) -> Iterator[tuple[int, int]]:
        x, i = (1 << weight) - 1, 0
        while x < 1 << 64 and i < most:
            yield i, x - (1 << 64) if x >> 63 else x
            i += 1
            if not x:
                return
            low = x & -x
            up = x + low
            x = up | ((x ^ up) // low) >> 2


@udtf(returnType="pos bigint, lat double, lon double")
class PolylinePoints:
    """The points of a polyline text."""

    def eval(self, text: str, precision: int) -> Iterator[tuple[int, float, float]]:
        from roadloom.functions.encoders import polyline_points

        for i, (lat, lon) in enumerate(polyline_points(text or "", precision)):
            yield i, lat, lon


TABLES = {"bit_subsets": BitSubsets, "weight_words": WeightWords, "polyline_points": PolylinePoints}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    ship(spark)
    for name, (parameters, result, expression) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
