"""Whole jobs over tables: partition, renumber, check, and reports on partitions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators.graphs import compacted, fragments
from roadloom.plans import flow, hierarchy
from roadloom.plans.frontier import weak_components
from roadloom.session import saved, ship
from roadloom.sources import formats

#: Metres to a degree of latitude, near enough over a cell.
METRES_PER_DEGREE = 111_320.0


def partition(edges: DataFrame, nodes: DataFrame, depth: int = 31, balance: float = 0.25, least: int = 50, level_sizes: Sequence[int] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(partition, directory): node, partition_id of a recursive bisection, and the levels grown from its pieces.

    With level sizes the cutting stops at a quarter of the smallest one, so that the assembly can come close to what was
    asked; the bisection's cells, numbered without gaps, fall into their connected pieces, and each level merges those
    below up to its size. Without level sizes there is no directory."""
    sizes = sorted(level_sizes)
    stop = max(1, sizes[0] // 4) if sizes else least
    part = saved(flow.bisection(edges, nodes, depth, balance, stop))
    if not sizes:
        return part, None
    pieces = fragments(edges, compacted(part.withColumnRenamed("partition_id", "cell")))
    return part, hierarchy.assembled(edges, saved(pieces), sizes)


def write_partition(edges: DataFrame, nodes: DataFrame, part: DataFrame, directory: DataFrame | None, out: str) -> None:
    """The files of a partition under `out`: partition (Parquet), cut and assignment (CSV), and the directory if there is one."""
    part.write.mode("overwrite").parquet(f"{out}/partition")
    formats.write_csv(formats.cut_arcs(edges, part, nodes), f"{out}/cut", "cut")
    formats.write_csv(formats.assignment(part, nodes), f"{out}/assignment", "assignment")
    if directory is not None:
        formats.write_directory(directory, f"{out}/levels")


def renumber(edges: DataFrame, nodes: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, cells, ordering) of an instance under the numbers that the overlay wants: border nodes of coarse cells
    first, then cell by cell."""
    ordering = saved(hierarchy.node_ordering(edges, cells))
    moved = nodes.join(ordering, nodes.id == ordering.old).select(F.col("new").alias("id"), "lat", "lon")
    return hierarchy.renumbered(edges, ordering), moved, hierarchy.renumbered_cells(cells, ordering), ordering


def cell_components(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """level, cells, whole (in one piece), pieces (of all cells), largest (nodes of the largest cell): whether the cells of
    each level hold together, whichever way their arcs run. All levels at once: a node counts once a level."""
    levels = cells.agg(F.max("level") + 1).first()[0]
    key = lambda c: (F.col(c) * levels + F.col("level")).cast("long")
    a = cells.select(F.col("node").alias("src"), "level", F.col("cell").alias("c_src"))
    b = cells.select(F.col("node").alias("dst"), "level", F.col("cell").alias("c_dst"))
    inner = edges.select("src", "dst").join(a, "src").join(b, ["dst", "level"]).where("c_src = c_dst").select(key("src").alias("src"), key("dst").alias("dst"))
    found = weak_components(inner, cells.select(key("node").alias("node")))
    of = cells.select(key("node").alias("node"), "level", "cell").join(found, "node")
    piece = of.groupBy("level", "cell", "component").agg(F.count(F.lit(1)).alias("n"))
    cell = piece.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("n"))
    return cell.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("pieces") == 1).alias("whole"), F.sum("pieces").alias("pieces"), F.max("n").alias("largest"))


def alpha_cells(nodes: DataFrame, cells: DataFrame, alpha: float) -> DataFrame:
    """level, cells, hull_corners, shape_corners, in_pieces: what alpha shapes (alpha in metres) make of the cells with three
    nodes or more, beside their convex hulls. nodes: id, lat, lon in micro-degrees; a cell is a task."""
    from roadloom.operators.spatial import alpha_edges, hull, rings

    def one(f: pd.DataFrame) -> pd.DataFrame:
        at = np.unique(f[["lon", "lat"]].to_numpy(float) / 1e6, axis=0)
        found = rings(alpha_edges(at, alpha / METRES_PER_DEGREE))
        corners = len(hull([*zip(f.lat.tolist(), f.lon.tolist(), strict=True)]))
        return pd.DataFrame({"level": [int(f.level.iloc[0])], "hull": [corners], "shape": [sum(map(len, found))], "rings": [len(found)]})

    ship(nodes.sparkSession)
    placed = cells.join(nodes.withColumnRenamed("id", "node"), "node")
    full = placed.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("level", "cell")
    each = placed.join(full, ["level", "cell"]).select("level", "cell", "lat", "lon").groupBy("level", "cell").applyInPandas(one, "level long, hull long, shape long, rings long")
    return each.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.sum("hull").alias("hull_corners"), F.sum("shape").alias("shape_corners"), F.count_if(F.col("rings") > 1).alias("in_pieces"))
