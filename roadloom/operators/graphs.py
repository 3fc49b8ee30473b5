"""Graphs as tables: node sets, arc lookups, changes, numberings and walks. Arcs are src, dst, w [, edge_id]."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.operators.relational import global_prefix_sums
from roadloom.session import saved, ship


def node_count(edges: DataFrame) -> DataFrame:
    """nodes (largest id + 1, at least 1), arcs: one row, for an empty table too."""
    return edges.agg(F.greatest(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(1)), F.lit(1)).cast("long").alias("nodes"), F.count(F.lit(1)).alias("arcs"))


def node_set(edges: DataFrame, least: int = 0) -> DataFrame:
    """node: 0 to the largest id of an arc, at least `least` nodes and never none."""
    n = max(least, node_count(edges).first()["nodes"])
    return edges.sparkSession.range(n).withColumnRenamed("id", "node")


def is_parallel(a_src: Column, a_dst: Column, b_src: Column, b_dst: Column) -> Column:
    """Whether two arcs run between the same ends in the same direction."""
    return (a_src == b_src) & (a_dst == b_dst)


def parallel_arcs(edges: DataFrame) -> DataFrame:
    """The arcs (edge_id, src, dst) that have a parallel one, with the number of arcs beside them."""
    many = edges.groupBy("src", "dst").agg((F.count(F.lit(1)) - 1).alias("beside")).where("beside > 0")
    return edges.join(many, ["src", "dst"]).select("edge_id", "src", "dst", "beside")


def found_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """src, dst, edge_id: the first arc (smallest edge_id) from src to dst of every row of wanted (src, dst); null if there
    is none. Ids beyond the graph have none either."""
    first = edges.groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))
    return wanted.select("src", "dst").join(first, ["src", "dst"], "left")


def inserted(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Arcs (edge_id, src, dst, w) with further ones, which take the numbers after the largest; nodes come with arcs."""
    top = edges.agg(F.coalesce(F.max("edge_id") + 1, F.lit(0)).alias("_top"))
    numbered = global_prefix_sums(more.select(F.struct("src", "dst", "w").alias("k"), "src", "dst", "w", F.lit(1).cast("long").alias("one")), "k", "one")
    added = numbered.join(F.broadcast(top)).select((F.col("_top") + F.col("prefix") - 1).alias("edge_id"), "src", "dst", "w")
    return edges.select("edge_id", "src", "dst", "w").union(added)


def removed(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Arcs without those of the listed numbers (edge_id)."""
    return edges.join(gone.select("edge_id"), "edge_id", "left_anti")


def same_cell(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, level, same: whether the nodes of each pair (a, b) lie in one cell, level by level."""
    a, b = (cells.select(F.col("node").alias(k), "level", F.col("cell").alias(f"c_{k}")) for k in "ab")
    return pairs.select("a", "b").join(a, "a").join(b, ["b", "level"]).select("a", "b", "level", (F.col("c_a") == F.col("c_b")).alias("same"))


def cells_on_level(cells: DataFrame) -> DataFrame:
    """level, cells: the largest cell number + 1, as cells are numbered from 0."""
    return cells.groupBy("level").agg((F.max("cell") + 1).alias("cells"))


def number_of_sets(components: DataFrame) -> DataFrame:
    """sets: how many components (node, component) there are; each holds its smallest node, which names it."""
    return components.agg(F.count_if(F.col("node") == F.col("component")).alias("sets"))


def compacted(labels: DataFrame) -> DataFrame:
    """node, cell: labels (node, cell) numbered from 0 without a gap, in the order of their smallest nodes. Only the first
    nodes of labels are ranked, in parallel ranges."""
    first = labels.groupBy("cell").agg(F.min("node").alias("first")).withColumn("one", F.lit(1).cast("long"))
    number = global_prefix_sums(first, "first", "one").select("cell", (F.col("prefix") - 1).alias("number"))
    return labels.join(number, "cell").select("node", F.col("number").alias("cell"))


def renumbering(ids: DataFrame) -> DataFrame:
    """old, new: the distinct ids (column id) by ascending id, from 0."""
    return compacted(ids.select(F.col("id").alias("node"), F.col("id").alias("cell")).distinct()).select(F.col("node").alias("old"), F.col("cell").alias("new"))


def contracted(sizes: DataFrame, arcs: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell, size) and (a, b, w) of a cell graph after its cells went to groups (cell, grp): sizes add up, so do the
    weights of arcs between two groups, and arcs inside one are gone."""
    size = sizes.join(groups, "cell").groupBy(F.col("grp").alias("cell")).agg(F.sum("size").alias("size"))
    a, b = (groups.select(F.col("cell").alias(k), F.col("grp").alias(f"g{k}")) for k in "ab")
    cross = arcs.join(a, "a").join(b, "b").where("ga <> gb")
    return size, cross.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum("w").alias("w"))


def complete_graph(sites: DataFrame) -> DataFrame:
    """i, j, w of all pairs of the sites of an instance (instance, id, x, y): planar distances, rounded, 0 to itself.
    Instances are small (a site meets those of its own instance only)."""
    from roadloom.functions.geo import euclidean_2d

    a = sites.select("instance", F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    b = sites.select("instance", F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    return a.join(b, "instance").select("instance", "i", "j", euclidean_2d(F.col("xi"), F.col("yi"), F.col("xj"), F.col("yj")).alias("w"))


def depth_first(arcs: DataFrame) -> DataFrame:
    """instance, pos, node, parent: the order in which a stack hands out the nodes reached from `start`, for arcs (instance,
    start, src, dst). A node's new targets are pushed in ascending order, so the largest comes off first; the parent of
    the start is null. The order is sequential by nature: an instance is one task and has to fit there."""

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for u, v in sorted(set(zip(f.src.tolist(), f.dst.tolist(), strict=True))):
            near.setdefault(u, []).append(v)
        start = int(f.start.iloc[0])
        stack, seen, rows = [(start, None)], {start}, []
        while stack:
            u, parent = stack.pop()
            rows.append((len(rows), u, parent))
            for v in near.get(u, ()):
                if v not in seen:
                    seen.add(v)
                    stack.append((v, u))
        out = pd.DataFrame({"pos": [r[0] for r in rows], "node": [r[1] for r in rows], "parent": pd.array([r[2] for r in rows], "Int64")})
        out.insert(0, "instance", f.instance.iloc[0])
        return out

    ship(arcs.sparkSession)
    return arcs.select("instance", "start", "src", "dst").groupBy("instance").applyInPandas(walk, "instance long, pos long, node long, parent long")


def fragments(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """node, cell: the weak pieces of every cell of a partition (node, cell), numbered by their first nodes."""
    from roadloom.plans.frontier import weak_components

    a, b = (partition.select(F.col("node").alias(k), F.col("cell").alias(f"c_{k}")) for k in ("src", "dst"))
    inner = edges.select("src", "dst").join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst")
    return compacted(saved(weak_components(inner, partition.select("node")).select("node", F.col("component").alias("cell"))))
