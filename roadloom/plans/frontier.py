"""Whole-graph algorithms as iterated joins: levels, distances, orders of removal, strong components, spanning trees.

Each round is one join and one aggregate, saved in the shared folder, so lineage stays flat and lost executors cost a
round at most. Graphs with many rounds (long diameters) are for the batched kernels while they fit, see ``batched``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.plans.components import clusters, components
from roadloom.session import saved


def bfs_levels(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """node, hops, parent: hops from the nearest source (node), with the smallest node one hop nearer.

    With targets (node) it ends with the level that discovers the first of them; sources are not discovered, so a target
    that is a source does not count. Arcs that a search must not take are filtered out of edges by the caller."""
    reached = saved(sources.select(F.col("node").cast("long"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast("long").alias("parent")).distinct())
    front, hops = reached, 0
    while True:
        hops += 1
        step = front.select(F.col("node").alias("src")).join(edges.select("src", "dst"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front = saved(step.join(reached.select("node"), "node", "left_anti").select("node", F.lit(hops).cast("long").alias("hops"), "parent"))
        if front.isEmpty():
            return reached
        reached = saved(reached.union(front)) if hops % 8 == 0 else reached.union(front)
        if targets is not None and not front.join(targets.select("node"), "node", "left_semi").isEmpty():
            return reached


def distances(edges: DataFrame, source: int) -> DataFrame:
    """node, dist from one source; edges (src, dst, w) with w >= 0."""
    return relaxed(edges, edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("node"))).select("node", "dist")


def relaxed(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, dist from each source (column node), by relaxing the arcs of improved nodes, all sources at once."""
    known = saved(sources.select(F.col("node").cast("long").alias("source"), F.col("node").cast("long"), F.lit(0).cast("long").alias("dist")).distinct())
    front, arcs = known, edges.select("src", "dst", "w")
    while True:
        step = front.withColumnRenamed("node", "src").join(arcs, "src").groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        merged = saved(known.join(step, ["source", "node"], "full").select("source", "node", F.least("dist", "new").alias("dist"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("better")))
        known, front = merged.select("source", "node", "dist"), merged.where("better").select("source", "node", "dist")
        if front.isEmpty():
            return known


def all_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, dist, parent (null at the source) of every node reached from each source (column node). The parent is
    the smallest nearer node on a shortest path; arcs have positive weights."""
    far = relaxed(edges, sources)
    tight = far.select("source", F.col("node").alias("src"), F.col("dist").alias("at")).join(edges.select("src", "dst", "w"), "src").select("source", F.col("dst").alias("node"), "src", (F.col("at") + F.col("w")).alias("dist"))
    parents = tight.join(far, ["source", "node", "dist"]).where("node <> source").groupBy("source", "node").agg(F.min("src").alias("parent"))
    return saved(far.join(parents, ["source", "node"], "left").select("source", "node", "dist", "parent"))


def joined_paths(far: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, target, distance, path of pairs (source, target) along the parents of all_distances; null where there is
    none. All paths go back one node a round, the finished ones leave the loop."""
    hop = far.select("source", F.col("node").alias("at"), "parent")
    ends = far.select("source", F.col("node").alias("target"), F.col("dist").alias("distance"))
    wanted = saved(pairs.select("source", "target").distinct().join(ends, ["source", "target"], "left"))
    left, done = wanted.where("distance IS NOT NULL").select("source", "target", F.col("target").alias("at"), F.array("target").alias("path")), None
    while not left.isEmpty():
        home = left.where("at = source").select("source", "target", "path")
        done = home if done is None else done.union(home)
        left = saved(left.where("at <> source").join(hop, ["source", "at"]).select("source", "target", F.col("parent").alias("at"), F.concat(F.array("parent"), "path").alias("path")))
    out = wanted.join(done, ["source", "target"], "left") if done is not None else wanted.withColumn("path", F.lit(None).cast("array<bigint>"))
    return pairs.select("source", "target").join(out, ["source", "target"], "left")


def weak_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest node); nodes: further nodes (node) that may have no edge."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("root", "component")
    # All other ends are in what is found.
    single = edges.where("src = dst OR src IS NULL OR dst IS NULL").select(F.explode(F.array("src", "dst")).alias("node"))
    single = single if nodes is None else single.union(nodes.select("node"))
    return found.union(single.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges left when nodes without an incoming or without an outgoing edge are removed again and again; empty exactly
    if the graph has no directed cycle. Self loops are cycles. A round compares ends; edges move only if some have to go."""
    left = saved(edges.select("src", "dst").distinct())
    while True:
        tails, heads = left.select(F.col("src").alias("node")).distinct(), left.select(F.col("dst").alias("node")).distinct()
        gone = saved(tails.join(heads, "node", "left_anti").withColumn("tail", F.lit(True)).union(heads.join(tails, "node", "left_anti").withColumn("tail", F.lit(False))))
        if gone.isEmpty():
            return left
        left = left.join(gone.where("tail").select(F.col("node").alias("src")), "src", "left_anti")
        left = saved(left.join(gone.where("NOT tail").select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component (its smallest node), by forward and backward colouring.

    Every open node takes the smallest node that reaches it as its colour; within a colour, the nodes that reach the
    colour's root backwards form a component. They leave, and the rest goes on."""
    every = saved(nodes.select(F.col("node").cast("long")).distinct())
    # Nodes outside of the core, where no cycle passes, are components of their own.
    left = saved(cyclic_core(edges.where("src <> dst")))
    open_nodes = saved(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    done = every.join(open_nodes, "node", "left_anti").select("node", F.col("node").alias("colour"))
    while not open_nodes.isEmpty():
        colour = open_nodes.withColumn("colour", F.col("node"))
        while True:
            come = left.join(colour.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            moved = saved(colour.join(come, "node", "left").select("node", F.least("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") < F.col("colour")).alias("moved")))
            colour = moved.select("node", "colour")
            if moved.where("moved").isEmpty():
                break
        inner = saved(left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), "colour"), "dst").where("c = colour").select("src", "dst", "colour"))
        back = saved(colour.where("node = colour"))
        front = back
        while not front.isEmpty():
            step = inner.join(front.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = saved(step.join(back.select("node"), "node", "left_anti"))
            back = back.union(front)
        back = saved(back)
        done = done.union(back)
        open_nodes = saved(open_nodes.join(back.select("node"), "node", "left_anti"))
        left = saved(left.join(open_nodes.select(F.col("node").alias("src")), "src", "left_semi").join(open_nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    return done.withColumnRenamed("colour", "component")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (edge_id, src, dst, w) of the minimum spanning forest by Borůvka rounds. Of equal weights the higher
    edge_id comes first, so the forest is unique."""
    label = saved(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("tree", F.col("node")))
    chosen = None
    while True:
        a, b = (label.select(F.col("node").alias(k), F.col("tree").alias(f"t_{k}")) for k in ("src", "dst"))
        cross = edges.join(a, "src").join(b, "dst").where("t_src <> t_dst")
        ends = cross.select(F.explode(F.array("t_src", "t_dst")).alias("tree"), F.struct("w", (-F.col("edge_id")).alias("k"), "src", "dst", "t_src", "t_dst").alias("e"))
        best = saved(ends.groupBy("tree").agg(F.min("e").alias("e")).select("e.*").distinct())
        if best.isEmpty():
            break
        own = best.select((-F.col("k")).alias("edge_id"), "src", "dst", "w")
        chosen = own if chosen is None else chosen.union(own)
        roots = saved(clusters(best.select(F.col("t_src").alias("a"), F.col("t_dst").alias("b"))))
        label = saved(label.join(roots.withColumnRenamed("node", "tree"), "tree", "left").select("node", F.coalesce("root", "tree").alias("tree")))
    return chosen if chosen is not None else edges.select("edge_id", "src", "dst", "w").limit(0)


def path_to(levels: DataFrame, target: int) -> DataFrame:
    """pos, node along the parents from a target of bfs_levels (node, hops, parent) back to its source. Levels are walked
    from the target's down, each by one join; the rows stay in the cluster."""
    levels = saved(levels)
    at, out = levels.where(F.col("node") == target), None
    for hops in range(levels.where(F.col("node") == target).agg(F.coalesce(F.max("hops"), F.lit(-1))).first()[0], -1, -1):
        row = at.select(F.col("hops").alias("pos"), "node")
        out = row if out is None else out.union(row)
        at = levels.where(F.col("hops") == hops - 1).join(F.broadcast(at.select(F.col("parent").alias("node"))), "node").select("node", "hops", "parent")  # a row
        at = saved(at) if hops % 8 == 0 else at
    return out if out is not None else levels.select(F.col("hops").alias("pos"), "node").limit(0)


def edge_ids(edges: DataFrame) -> DataFrame:
    """Edges with edge_id in (src, dst, w) order from 0: ranges are numbered in parallel, then shifted."""
    ordered = saved(edges.repartitionByRange("src", "dst", "w").sortWithinPartitions("src", "dst", "w").withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(F.broadcast(base.select("part", "low", "base")), "part").select(*edges.columns, (F.col("k") - F.col("low") + F.col("base")).alias("edge_id"))
