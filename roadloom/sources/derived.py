"""Deterministic graphs and coordinates: grids, and what the star-schema tables give.

Every input exists twice, as a DataFrame and as the same relation in DuckDB's SQL (the *_SQL strings, common table
expressions to paste after WITH), so results can be checked against each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a large table that one task of a shuffle takes.
PART_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int:
    """Tasks among which a shuffle of a table's rows goes; grows with the table, so that a task's share does not. Never fewer
    than the session's, as joins would then move both sides again."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, name).count() // PART_ROWS))


def grid_edges(spark: SparkSession, side: int, one_way: bool = False) -> DataFrame:
    """src, dst, w of a side x side grid, weights from the position; one_way: the rows run east only."""
    cells = spark.range(side * side).selectExpr(f"id div {side} AS r", f"id % {side} AS c")
    east = cells.where(f"c < {side - 1}").selectExpr(f"r * {side} + c AS src", f"r * {side} + c + 1 AS dst", "1 + (r * 7 + c * 3) % 5 AS w")
    south = cells.where(f"r < {side - 1}").selectExpr(f"r * {side} + c AS src", f"r * {side} + c + {side} AS dst", "1 + (r * 5 + c) % 5 AS w")
    back = south if one_way else east.union(south)
    return east.union(south).union(back.selectExpr("dst AS src", "src AS dst", "w"))


def grid_cells(spark: SparkSession, side: int) -> DataFrame:
    """node, level, cell: level 0 has blocks of 2 x 2, each further level doubles the side, up to one cell."""
    top, block, out = 0, 2, None
    while True:
        across = max(1, side // block)
        part = spark.range(side * side).selectExpr("id AS node", f"{top} AS level", f"(id div {side}) div {block} * {across} + (id % {side}) div {block} AS cell")
        out = part if out is None else out.union(part)
        if block >= side:
            return out
        top, block = top + 1, block * 2


def grid_nodes(spark: SparkSession, side: int) -> DataFrame:
    """id, lat, lon (micro-degrees) of grid nodes: rows go north, columns east."""
    return spark.range(side * side).selectExpr("id", f"cast((id div {side}) * 1000 AS int) AS lat", f"cast((id % {side}) * 1000 AS int) AS lon")


def grid_sql(side: int, one_way: bool = False) -> str:
    back = "south" if one_way else "(SELECT * FROM east UNION ALL SELECT * FROM south)"
    return f"""
rc AS (SELECT i // {side} AS r, i % {side} AS c FROM range({side * side}) t(i)),
east AS (SELECT r * {side} + c AS src, r * {side} + c + 1 AS dst, 1 + (r * 7 + c * 3) % 5 AS w FROM rc WHERE c < {side - 1}),
south AS (SELECT r * {side} + c AS src, r * {side} + c + {side} AS dst, 1 + (r * 5 + c) % 5 AS w FROM rc WHERE r < {side - 1}),
grid AS (SELECT * FROM east UNION ALL SELECT * FROM south UNION ALL SELECT dst, src, w FROM {back})"""


def grid_cells_sql(side: int) -> str:
    parts, level, block = [], 0, 2
    while True:
        across = max(1, side // block)
        parts.append(f"SELECT i AS node, {level} AS level, (i // {side}) // {block} * {across} + (i % {side}) // {block} AS cell FROM range({side * side}) t(i)")
        if block >= side:
            return "cells AS (" + " UNION ALL ".join(parts) + ")"
        level, block = level + 1, block * 2


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon (micro-degrees): customers hashed over the globe."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "cast(((c_custkey * 7919) % 170000000 + c_custkey * 104729) % 170000000 - 85000000 AS int) AS lat", "cast((c_custkey * 1299709) % 360000000 - 180000000 AS int) AS lon"
    )


GEO_SQL = """
geo AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 170000000 + c_custkey * 104729) % 170000000 - 85000000 AS lat,
  (c_custkey * 1299709) % 360000000 - 180000000 AS lon FROM customer)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w: line items from customers of nation src and suppliers of nation dst."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select("l_orderkey", "l_suppkey")
    flows = line.join(t("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS c_custkey"), "l_orderkey")
    named = flows.join(t("customer").selectExpr("c_custkey", "cast(c_nationkey AS bigint) AS src"), "c_custkey").join(t("supplier").selectExpr("s_suppkey AS l_suppkey", "cast(s_nationkey AS bigint) AS dst"), "l_suppkey")
    return named.groupBy("src", "dst").count().withColumnRenamed("count", "w")


TRADE_SQL = """
trade AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS w FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w: consecutive parts of an order, with the smallest quantity. The arcs of a source lie in one partition, so
    that joins on src need not move them once they are saved."""
    n, order = parts(spark, sf_dir), ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", *order).repartition(n, "l_orderkey")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*order))
    steps = line.select(F.col("l_partkey").alias("src"), after.alias("dst"), F.col("l_quantity").cast("long").alias("w")).where("dst IS NOT NULL AND src <> dst")
    return steps.repartition(n, "src").groupBy("src", "dst").agg(F.min("w").alias("w"))


COPURCHASE_SQL = """
copurchase AS (SELECT src, dst, min(w) AS w FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst,
    l_quantity::BIGINT AS w FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL)"""
