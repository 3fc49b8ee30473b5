"""Aggregates, windows, merges and orders over plain tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.session import ship


def bounding_boxes(points: DataFrame, *keys: str) -> DataFrame:
    """min_lat, min_lon, max_lat, max_lon of points (lat, lon), by group."""
    return points.groupBy(*keys).agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def merged_parallel(edges: DataFrame) -> DataFrame:
    """One arc for each (src, dst), capacities summed."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def asymmetric_arcs(edges: DataFrame) -> DataFrame:
    """Arcs without an opposite of equal weight; none for a symmetric graph."""
    return edges.join(reversed_edges(edges), ["src", "dst", "w"], "left_anti")


def integrity_violations(edges: DataFrame, nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """problem, src, dst: arcs whose ends are no node, or without a weight. Arcs meet the nodes at one end, then at the
    other, in so many parts."""
    spread = (lambda df, c: df.repartition(parts, c)) if parts else (lambda df, c: df)
    here = lambda c: spread(nodes.select(F.col("node").alias(c)).distinct(), c).withColumn(f"_{c}", F.lit(True))
    ends = spread(edges.select("src", "dst"), "src").join(here("src"), "src", "left")
    lost = spread(ends, "dst").join(here("dst"), "dst", "left").where("_src IS NULL OR _dst IS NULL").select(F.lit("unknown node").alias("problem"), "src", "dst").distinct()
    return lost.union(edges.where("w IS NULL").select(F.lit("no weight"), "src", "dst"))


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k smallest rows, ascending."""
    return rows.orderBy(key).limit(k)


def merged_runs(parts: list[DataFrame], *keys: str) -> DataFrame:
    """Sorted union of tables."""
    return reduce(DataFrame.unionByName, parts).orderBy(*keys)


def prefix_sums(values: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """values with prefix: the inclusive running sum in each group."""
    return values.withColumn("prefix", F.sum(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def global_prefix_sums(values: DataFrame, order: str, value: str, parts: int = 200) -> DataFrame:
    """prefix over the whole table in one order, without one task for all rows: ranges are summed in parallel, their
    totals (a row a range) are summed in turn, and each row adds its range's base."""
    from roadloom.session import saved

    ranged = saved(values.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_total"))
    base = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("prefix", inner).join(F.broadcast(base), "_part").withColumn("prefix", F.col("prefix") + F.col("_base")).drop("_part", "_base")


def range_sums(prefixes: DataFrame, ranges: DataFrame, group: str, order: str) -> DataFrame:
    """For ranges (group, i, j) the sum over (i, j]: i itself left out, 0 where i >= j."""
    low = prefixes.select(group, F.col(order).alias("i"), F.col("prefix").alias("low"))
    high = prefixes.select(group, F.col(order).alias("j"), F.col("prefix").alias("high"))
    return ranges.join(low, [group, "i"]).join(high, [group, "j"]).select(group, "i", "j", F.when(F.col("i") >= F.col("j"), F.lit(0)).otherwise(F.col("high") - F.col("low")).alias("total"))


def select_prefix(prefixes: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    """For each group the last position whose prefix sum is at most the value; groups without one are absent."""
    return prefixes.where(F.col("prefix") <= value).groupBy(group).agg(F.max(order).alias("pos"))


def updated(values: DataFrame, deltas: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Values (group, order, value) after point additions (group, order, value): sums by place. An addition past the end, or
    to a group that is not there, is an error."""
    added = deltas.groupBy(group, order).agg(F.sum(value).alias("_delta"))
    both = values.select(group, order, value, F.lit(True).alias("_there")).join(added, [group, order], "full")
    there = F.when(F.col("_there"), F.col(value) + F.coalesce("_delta", F.lit(0))).otherwise(F.raise_error(F.lit("index out of range")).cast("bigint"))
    return both.select(group, order, there.alias(value))


def zeros(spark, n: int) -> DataFrame:
    """g, i, value: one group of n places with value 0."""
    return spark.range(n).selectExpr("0L AS g", "id AS i", "0L AS value")


def runs(rows: DataFrame, group: str, order: list[str], same: Column) -> DataFrame:
    """rows with run: numbers from 1 for maximal runs in each group; `same` says whether a row continues the run, and may
    use lag() columns named prev_* that the caller adds, or any expression over the window of (group, order)."""
    w = Window.partitionBy(group).orderBy(*order)
    flagged = rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return flagged.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def equal_runs(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """group, run, value, length of maximal runs of equal neighbours."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = rows.withColumn("_prev", F.lag(value).over(w))
    return runs(marked, group, order, F.col("_prev") == F.col(value)).groupBy(group, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length"))


def folded(rows: DataFrame, group: str, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """An order-dependent fold, one group a task at a time."""
    ship(rows.sparkSession)
    return rows.groupBy(group).applyInPandas(fold, schema)


def next_fit(items: DataFrame, group: str, order: str, size: str, capacity: int) -> DataFrame:
    """group, item, bin by next-fit packing in order. Items larger than the capacity are an error."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")

    def pack(frames):
        last, used, at = None, 0, 0
        for f in frames:
            bins = []
            for g, s in zip(f[group].tolist(), f[size].tolist(), strict=True):
                if s > capacity:
                    raise ValueError("an item is larger than the capacity")
                if g != last:
                    last, used, at = g, 0, 0
                if used + s > capacity:
                    at, used = at + 1, 0
                used += s
                bins.append(at)
            yield pd.DataFrame({group: f[group], order: f[order], "bin": bins})

    ship(items.sparkSession)
    ordered = items.select(group, order, size).repartition(group).sortWithinPartitions(group, order)
    return ordered.mapInPandas(pack, f"{group} long, {order} long, bin long")


def lru_hits(accesses: DataFrame, group: str, order: list[str], key: str, capacity: int) -> DataFrame:
    """group, hits, misses of a least-recently-used cache over each group's accesses in order."""

    def replay(f: pd.DataFrame) -> pd.DataFrame:
        from collections import OrderedDict

        cache, hits = OrderedDict(), 0
        for k in f.sort_values(order)[key].tolist():
            if k in cache:
                hits += 1
                cache.move_to_end(k)
            else:
                cache[k] = True
                if len(cache) > capacity:
                    cache.popitem(last=False)
        return pd.DataFrame({group: [f[group].iloc[0]], "hits": [hits], "misses": [len(f) - hits]})

    return folded(accesses.select(group, *order, key), group, replay, f"{group} long, hits long, misses long")


def _middle(sizes: DataFrame, *keys: str) -> DataFrame:
    """keys, median: the element n / 2 (from 0) of the ascending sizes of a group. Equal sizes are counted before they are
    ranked, so a group is as many rows as it has different sizes."""
    counted = sizes.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys).orderBy("size")
    ranked = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("of_all", F.sum("n").over(Window.partitionBy(*keys)))
    return ranked.where("upto > of_all div 2 AND upto - n <= of_all div 2").select(*keys, F.col("size").alias("median"))


def _spread(sizes: DataFrame, *keys: str) -> DataFrame:
    """keys, cells, smallest, mean, median, largest, biased_mean of sizes."""
    total = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.min("size").alias("smallest"), F.avg("size").alias("mean"), F.max("size").alias("largest"), (F.sum(F.col("size") * F.col("size")) / F.sum("size")).alias("biased_mean"))
    return total.join(_middle(sizes, *keys), [*keys])


def cell_statistics(cells: DataFrame) -> DataFrame:
    """level, cells, mean, median (element n / 2), largest and size-biased mean of cell sizes; cells: node, level, cell."""
    sizes = cells.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("size"))
    return _spread(sizes, "level").select("level", "cells", "mean", "median", "largest", "biased_mean")


def border_statistics(border: DataFrame) -> DataFrame:
    """level, cells (that have a border), mean, median, largest and size-biased mean of the numbers of border nodes; border:
    level, cell, node."""
    sizes = border.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("size"))
    return _spread(sizes, "level").select("level", "cells", "mean", "median", "largest", "biased_mean")


def partition_statistics(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """cut (arcs between cells), cells, smallest, median, largest of a partition (node, cell)."""
    a, b = (partition.select(F.col("node").alias(k), F.col("cell").alias(f"c_{k}")) for k in ("src", "dst"))
    cut = edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("c_src") != F.col("c_dst")).alias("cut"))
    sizes = partition.groupBy(F.lit(0).alias("_all"), "cell").agg(F.count(F.lit(1)).alias("size"))
    return cut.crossJoin(_spread(sizes, "_all").select("cells", "smallest", "median", "largest"))  # a row each


def partition_levels(partition: DataFrame) -> DataFrame:
    """level, cells, nodes: how deep the cells of a bisection (node, partition_id) lie."""
    from roadloom.functions.bits import level

    return partition.groupBy(level(F.col("partition_id")).alias("level")).agg(F.countDistinct("partition_id").alias("cells"), F.count(F.lit(1)).alias("nodes"))


def rank_medians(timings: DataFrame) -> DataFrame:
    """engine, bucket (rounded binary logarithm of the rank), median time."""
    return timings.groupBy("engine", F.round(F.log2("rank")).cast("long").alias("bucket")).agg(F.expr("percentile(nanos, 0.5)").alias("median"))


def speedups(timings: DataFrame, base: str, other: str) -> DataFrame:
    """bucket, ratio of the medians of two engines."""
    wide = rank_medians(timings).groupBy("bucket").pivot("engine", [base, other]).agg(F.first("median"))
    return wide.select("bucket", (F.col(base) / F.col(other)).alias("ratio"))
