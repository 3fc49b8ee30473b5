"""Vector-tile geometry streams (column expressions) and polylines (Arrow-batched)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.bits import zigzag
from roadloom.session import ship

# Fixed values of the vector tile format.
MOVE_TO, LINE_TO, CLOSE_PATH, MAX_COUNT = 1, 2, 7, (1 << 29) - 1


def command_integer(command: Column, count: Column) -> Column:
    """A command and its repeat count in one number; null where the count does not fit."""
    return F.when(count.between(0, MAX_COUNT), F.shiftleft(count.cast("long"), 3).bitwiseOR(command.cast("long").bitwiseAND(F.lit(7))))


def command_and_count(value: Column) -> Column:
    return F.struct(value.bitwiseAND(F.lit(7)).alias("command"), F.shiftright(value, 3).alias("count"))


def geometry(xs: Column, ys: Column, closed: bool = False) -> Column:
    """The integer stream of a line (or, closed, a ring): move to the first point, lines to the rest, deltas zigzagged."""
    n = F.size(xs)

    def delta(v: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(v, i - 1))
        return zigzag(F.get(v, i) - before)

    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(delta(xs, i), delta(ys, i)))
    head = F.concat(F.array(command_integer(F.lit(MOVE_TO), F.lit(1))), F.get(pairs, F.lit(0)))
    tail = F.when(n > 1, F.concat(F.array(command_integer(F.lit(LINE_TO), n - 1)), F.flatten(F.slice(pairs, 2, F.greatest(n - 1, F.lit(1)))))).otherwise(F.array().cast("array<bigint>"))
    parts = [head, tail] + ([F.array(command_integer(F.lit(CLOSE_PATH), F.lit(1)))] if closed else [])
    return F.when(n > 0, F.concat(*parts)).otherwise(F.array().cast("array<bigint>"))


def polyline_text(points: list[tuple[float, float]], precision: int = 5) -> str:
    """Points (lat, lon) as text: rounded deltas, zigzagged, in groups of five bits from the low end."""
    out, last = [], (0, 0)
    for point in points:
        here = tuple(int(abs(v) * 10**precision + 0.5) * (1 if v >= 0 else -1) for v in point)
        for now, before in zip(here, last, strict=True):
            v = (now - before) * 2
            v = ~v + 0 if v < 0 else v
            while v >= 32:
                out.append(chr((v & 31 | 32) + 63))
                v >>= 5
            out.append(chr(v + 63))
        last = here
    return "".join(out)


def polyline_points(text: str, precision: int = 5) -> list[tuple[float, float]]:
    values, v, shift = [], 0, 0
    for c in text:
        bits = ord(c) - 63
        v |= (bits & 31) << shift
        shift += 5
        if bits < 32:
            values.append(~(v >> 1) if v & 1 else v >> 1)
            v = shift = 0
    out, lat, lon = [], 0, 0
    for i in range(0, len(values) - 1, 2):
        lat, lon = lat + values[i], lon + values[i + 1]
        out.append((lat / 10**precision, lon / 10**precision))
    return out


def polyline_encode(lats: Column, lons: Column, precision: int = 5) -> Column:
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def encode(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else polyline_text([*zip(x, y, strict=True)], precision) for x, y in zip(a, b, strict=True)])

    return encode(lats, lons)


def polyline_decode(text: Column, precision: int = 5) -> Column:
    ship(SparkSession.active())

    @F.pandas_udf("array<struct<lat:double,lon:double>>")
    def decode(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"lat": a, "lon": b} for a, b in polyline_points(t, precision)] for t in s])

    return decode(text)
