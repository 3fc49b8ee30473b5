"""Bloom filters and count-min sketches as tables, so they build by partial aggregation and probe by joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, hash functions) for n keys at false-positive rate p."""
    return max(1, int(n * abs(math.log(p)) / math.log(2) ** 2)), max(1, int(math.log2(1 / p)))


def _positions(key: Column, bits: int, k: int) -> Column:
    a, b = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.pmod(a, F.lit(bits)) + i * F.pmod(b, F.lit(bits)), F.lit(bits)))


def bloom_filter(rows: DataFrame, key: str, n: int, p: float) -> DataFrame:
    """word, bits: the set bits of the filter in words of 62; merging filters is a bitwise or by word."""
    bits, k = bloom_size(n, p)
    spots = rows.select(F.explode(_positions(F.col(key), bits, k)).alias("spot"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("spot") % 62).cast("int"))
    return spots.groupBy(F.floor(F.col("spot") / 62).alias("word")).agg(F.bit_or(one).alias("bits"))


def bloom_contains(rows: DataFrame, key: str, bloom: DataFrame, n: int, p: float) -> DataFrame:
    """rows with maybe: false only if the key was never added."""
    bits, k = bloom_size(n, p)
    probes = rows.select(key).distinct().withColumn("spot", F.explode(_positions(F.col(key), bits, k)))
    hit = probes.withColumn("word", F.floor(F.col("spot") / 62)).join(bloom, "word", "left")
    bit = F.coalesce(F.call_function("shiftright", F.col("bits"), (F.col("spot") % 62).cast("int")).bitwiseAND(F.lit(1)), F.lit(0).cast("long"))
    return rows.join(hit.groupBy(key).agg((F.min(bit) == 1).alias("maybe")), key)


def count_min_size(width_error: float, failure: float) -> tuple[int, int]:
    """(width, depth): estimates exceed counts by at most width_error * total with probability 1 - failure."""
    return max(1, math.ceil(math.e / width_error)), max(1, math.ceil(math.log(1 / failure)))


def count_min(rows: DataFrame, key: str, width_error: float, failure: float) -> DataFrame:
    """row, bucket, n: the counters; merging sketches is a sum by (row, bucket). Equal keys are counted before hashing."""
    width, depth = count_min_size(width_error, failure)
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    cells = counted.select("c", F.posexplode(F.array(*(F.pmod(F.xxhash64(F.col(key), F.lit(r)), F.lit(width)) for r in range(depth)))).alias("row", "bucket"))
    return cells.groupBy("row", "bucket").agg(F.sum("c").alias("n"))


def count_min_estimates(keys: DataFrame, key: str, sketch: DataFrame, width_error: float, failure: float) -> DataFrame:
    """key, estimate: at least the true count."""
    width, depth = count_min_size(width_error, failure)
    cells = keys.select(key).distinct().select(key, F.posexplode(F.array(*(F.pmod(F.xxhash64(F.col(key), F.lit(r)), F.lit(width)) for r in range(depth)))).alias("row", "bucket"))
    return cells.join(sketch, ["row", "bucket"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
