"""Connected components of a table of links, by contraction in saved rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.session import saved

#: Links that a partition of a saved round holds at least; rounds shrink, and their tasks with them.
ROUND_ROWS = 100_000


def clusters(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """node, root of every node of links (a, b): nodes have one root exactly if a path joins them. Nodes are longs.

    In a round every node goes to the node of the least priority among itself and its neighbours, and the links between
    different targets go on to the next round. Priorities are hashes of node and round, so chains of ascending numbers
    shrink as fast as dense groups (a constant share a round is expected). A round is one aggregate, combined before its
    shuffle, and two joins; only its links are saved, and no neighbourhood is collected.
    """
    left, steps = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), []
    while n := left.count():
        if len(steps) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        left = left.coalesce(1 + n // ROUND_ROWS)
        first = lambda c, k=len(steps): F.struct(F.xxhash64(c, F.lit(k)).alias("p"), F.col(c).alias("to"))
        ends = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ends.groupBy("a").agg(F.min(first("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", first("a"))["to"].alias("to"))
        steps.append(near)
        ma, mb = (near.select(F.col("node").alias(c), F.col("to").alias(f"m{c}")) for c in ("a", "b"))
        moved = left.join(ma, "a").join(mb, "b").where("ma <> mb")
        left = saved(moved.select(F.greatest("ma", "mb").alias("a"), F.least("ma", "mb").alias("b")).distinct())
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].select("node", F.col("to").alias("root"))
    for near in steps[1:]:
        out = out.join(near.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of links (a, b)."""
    found = saved(clusters(links))
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))


def extended(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root after further links (a, b); roots: what ``clusters`` or this function gave before. Only links between
    different roots are worked on."""
    if roots is None:
        return saved(clusters(links))
    a, b = (roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in ("a", "b"))
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    new = saved(clusters(lifted))
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return saved(moved.union(new.join(roots.select("node"), "node", "left_anti").select("node", "root")))
