"""Readers and writers: tables are written as text in the shared folder, in each format, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators import spatial
from roadloom.queries.registry import registry
from roadloom.session import checkpoint_dir, saved
from roadloom.sources import formats
from roadloom.sources.derived import COPURCHASE_SQL, GEO_SQL, copurchase, geo, grid_cells, grid_cells_sql, parts, table

QUERIES, ORACLE_SQL, query = registry()


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}/{name}"


def _text(lines: DataFrame, name: str, files: int = 4) -> str:
    """Writes rows (k, value) as lines in order of k in one file each range, and returns the folder."""
    at = _folder(lines.sparkSession, name)
    lines.repartitionByRange(files, "k").sortWithinPartitions("k").select("value").write.text(at)
    return at


@query(f"WITH {COPURCHASE_SQL} SELECT src, dst, w FROM copurchase")
def dimacs_graph(spark, sf_dir):
    """Arcs through the DIMACS format; self loops and broken lines between them are dropped."""
    e = saved(copurchase(spark, sf_dir)).selectExpr("src AS k", "concat('a ', src + 1, ' ', dst + 1, ' ', w) AS value")
    odd = spark.sql("SELECT -1L AS k, 'p sp 9 9' AS value UNION ALL SELECT 3L, 'c a comment' UNION ALL SELECT 4L, 'a 5 5 1' UNION ALL SELECT 4L, 'a 5' UNION ALL SELECT 4L, 'a x y 1'")
    return formats.read_dimacs(spark, _text(e.union(odd), "dimacs", parts(spark, sf_dir)))


@query(f"WITH {GEO_SQL} SELECT id, lat::INT AS lat, lon::INT AS lon FROM geo")
def dimacs_coordinates(spark, sf_dir):
    return formats.read_dimacs_coordinates(spark, _text(geo(spark, sf_dir).selectExpr("id AS k", "concat('v ', id + 1, ' ', lon, ' ', lat) AS value"), "coordinates"))


@query(f"""WITH {COPURCHASE_SQL}, d AS (SELECT src, dst, w, (src + dst) % 4 AS way FROM copurchase)
SELECT src, dst, w FROM d WHERE way IN (0, 1) UNION ALL SELECT dst, src, w FROM d WHERE way IN (0, 2)""")
def ddsg_graph(spark, sf_dir):
    """Arcs through the DDSG format: both ways, forward, backward and closed."""
    lines = saved(copurchase(spark, sf_dir)).selectExpr("src AS k", "concat_ws(' ', src, dst, w, (src + dst) % 4) AS value")
    head = spark.sql("SELECT -2L, 'd' UNION ALL SELECT -1L, '9 9'")
    return formats.read_ddsg(spark, _text(lines.union(head), "ddsg", parts(spark, sf_dir)))


@query("SELECT c_custkey AS id, (c_custkey * 7919 % 18000000) / 1e5 AS lon, (c_custkey * 104729 % 8000000) / 1e5 AS lat FROM customer")
def ddsg_coordinates(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "concat_ws(' ', c_custkey, c_custkey * 7919 % 18000000, c_custkey * 104729 % 8000000) AS value")
    return formats.read_ddsg_coordinates(spark, _text(lines.union(spark.sql("SELECT -1L, '9'")), "ddsg"))


@query(f"WITH {COPURCHASE_SQL} SELECT src, dst, 1::BIGINT AS w FROM copurchase WHERE src >= 0")
def metis_graph(spark, sf_dir):
    """Arcs through the METIS format: a line a node, with comments between."""
    e = saved(copurchase(spark, sf_dir))
    n = e.agg(F.max(F.greatest("src", "dst")) + 1).first()[0]
    lists = e.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(F.col("dst") + 1)), " ").alias("value"))
    lines = spark.range(n).join(lists, F.col("id") == F.col("src"), "left").select(F.col("id").alias("k"), F.coalesce("value", F.lit("")).alias("value"))
    lines = lines.union(spark.sql(f"SELECT -1L, '{n} 0' UNION ALL SELECT -2L, '% a comment'"))
    return formats.read_metis(spark, _text(lines, "metis", parts(spark, sf_dir)))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, (c_custkey * 7919 % 18000000) / 1e5 AS lon, (c_custkey * 104729 % 8000000) / 1e5 AS lat FROM customer")
def metis_coordinates(spark, sf_dir):
    at = _folder(spark, "metis")
    table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "concat_ws(' ', c_custkey * 7919 % 18000000, c_custkey * 104729 % 8000000, 1) AS value").coalesce(1).sortWithinPartitions("k").select("value").write.text(at)
    return formats.read_metis_coordinates(spark, at)


_SITES = "SELECT s_suppkey AS i, s_suppkey * 37 % 101 AS x, s_suppkey * 53 % 97 AS y FROM supplier WHERE s_suppkey <= 30"


@query(f"WITH s AS (SELECT i, x, y, row_number() OVER (ORDER BY i) - 1 AS k FROM ({_SITES})) SELECT a.k AS i, b.k AS j, floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) + 0.5)::BIGINT AS w FROM s a, s b")
def tsplib_sites(spark, sf_dir):
    """Distances of an instance of planar sites (a file of thirty, the format's whole)."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey <= 30").selectExpr("s_suppkey AS k", "concat_ws(' ', s_suppkey, s_suppkey * 37 % 101, s_suppkey * 53 % 97) AS value")
    head = spark.createDataFrame([(-3, f"DIMENSION: {s.count()}"), (-2, "EDGE_WEIGHT_TYPE: EUC_2D"), (-1, "NODE_COORD_SECTION"), (1 << 40, "EOF")], "k long, value string")
    at = _folder(spark, "tsplib")
    s.union(head).coalesce(1).sortWithinPartitions("k").select("value").write.text(at)
    return formats.read_tsplib(spark, at)


@query("SELECT i, j, CASE WHEN i = j THEN 0 ELSE (i * 31 + j * 17) % 50 + 1 END::BIGINT AS w FROM range(12) a(i), range(12) b(j)")
def tsplib_matrix(spark, sf_dir):
    """Distances of an instance with a full matrix."""
    rows = "\n".join(" ".join(str(0 if i == j else (i * 31 + j * 17) % 50 + 1) for j in range(12)) for i in range(12))
    at = _folder(spark, "tsplib")
    text = f"NAME: m\nDIMENSION: 12\nEDGE_WEIGHT_TYPE: EXPLICIT\nEDGE_WEIGHT_FORMAT: FULL_MATRIX\nEDGE_WEIGHT_SECTION\n{rows}\nEOF"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
    return formats.read_tsplib(spark, at)


@query("SELECT o_custkey AS source, o_orderkey AS target, 4::BIGINT AS rank, o_orderkey * 3 AS distance FROM orders")
def pairs_csv(spark, sf_dir):
    """Pairs through their CSV; lines that are no pairs are dropped."""
    at = _folder(spark, "pairs")
    p = table(spark, sf_dir, "orders").selectExpr("o_custkey AS source", "o_orderkey AS target", "4L AS rank", "o_orderkey * 3 AS distance")
    formats.write_csv(p, at, "pairs")
    spark.createDataFrame([("no,pair",), ("1,x,2,3",)], "value string").coalesce(1).write.mode("append").option("compression", "none").text(at)
    return formats.read_pairs(spark, at).where("distance IS NOT NULL")


@query(f"WITH {COPURCHASE_SQL}, {GEO_SQL} SELECT src, dst, w, a.lat::BIGINT AS lat FROM copurchase JOIN geo a ON id = src")
def ingested(spark, sf_dir):
    """A graph and its coordinates from text into tables, and joined from there."""
    n = parts(spark, sf_dir)
    e = _text(saved(copurchase(spark, sf_dir)).selectExpr("src AS k", "concat('a ', src + 1, ' ', dst + 1, ' ', w) AS value"), "dimacs", n)
    g = _text(geo(spark, sf_dir).selectExpr("id AS k", "concat('v ', id + 1, ' ', lon, ' ', lat) AS value"), "coordinates", parts(spark, sf_dir, "customer"))
    out = _folder(spark, "tables")
    formats.ingest(spark, "dimacs", e, g, out)
    nodes = spark.read.parquet(f"{out}/nodes").selectExpr("id AS src", "cast(lat AS bigint) AS lat")
    return formats.narrowed(formats.read_edges(spark, out)).repartition(n, "src").join(nodes, "src")


@query(f"WITH {grid_cells_sql(16)} SELECT node, level::BIGINT AS level, cell::BIGINT AS cell FROM cells")
def stored_directory(spark, sf_dir):
    at = _folder(spark, "levels")
    formats.write_directory(grid_cells(spark, 16), at)
    return formats.read_directory(spark, at).withColumn("level", F.col("level").cast("long"))


@query(f"WITH {GEO_SQL} SELECT id FROM geo WHERE lat BETWEEN -40000000 AND 20000000 AND lon BETWEEN -60000000 AND 90000000")
def clustered_window(spark, sf_dir):
    """A window over points that lie along the Z-order curve in their files."""
    at = _folder(spark, "points")
    spatial.write_clustered(geo(spark, sf_dir), at, 8)
    return spatial.window_filter(spark.read.parquet(at), (-40_000_000, -60_000_000, 20_000_000, 90_000_000)).select("id")
