"""Hulls, triangulations, exports and round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.operators import graphs, spatial, tours
from roadloom.queries.registry import registry
from roadloom.sources.derived import COPURCHASE_SQL, GEO_SQL, copurchase, geo, table
from roadloom.sources.formats import assignment, boundary_points, point_features, polygon_features

QUERIES, ORACLE_SQL, query = registry()


def _grouped(spark, sf_dir):
    return geo(spark, sf_dir).select((F.col("id") % 25).alias("cell"), "id", "lat", "lon")


#: The hulls' edges: from each corner the edge that leaves all others on its left, and none behind.
OUTER_SQL = f"""{GEO_SQL}, g AS (SELECT DISTINCT id % 25 AS cell, lat::BIGINT AS lat, lon::BIGINT AS lon FROM geo),
e AS (SELECT a.cell, a.lat, a.lon, b.lat AS blat, b.lon AS blon FROM g a JOIN g b ON a.cell = b.cell AND (a.lat, a.lon) <> (b.lat, b.lon)),
outer_edges AS (SELECT cell, lat, lon, blat, blon FROM e WHERE NOT EXISTS (SELECT 1 FROM g c, LATERAL (SELECT (e.blon - e.lon)::HUGEINT * (c.lat - e.lat) - (e.blat - e.lat)::HUGEINT * (c.lon - e.lon) AS turn) t
  WHERE c.cell = e.cell AND (turn < 0 OR turn = 0 AND ((c.lon - e.lon)::HUGEINT * (e.blon - e.lon) + (c.lat - e.lat)::HUGEINT * (e.blat - e.lat) < 0 OR (c.lon - e.lon)::HUGEINT * (c.lon - e.lon) + (c.lat - e.lat)::HUGEINT * (c.lat - e.lat) > (e.blon - e.lon)::HUGEINT * (e.blon - e.lon) + (e.blat - e.lat)::HUGEINT * (e.blat - e.lat)))))"""
RING_SQL = f"""RECURSIVE {OUTER_SQL}, first AS (SELECT cell, arg_min(lat, (lon, lat)) AS lat, min(lon) AS lon FROM outer_edges GROUP BY cell),
ring(cell, pos, lat, lon) AS (SELECT cell, 0::BIGINT, lat, lon FROM first UNION ALL SELECT r.cell, r.pos + 1, o.blat, o.blon FROM ring r JOIN outer_edges o ON o.cell = r.cell AND o.lat = r.lat AND o.lon = r.lon JOIN first f ON f.cell = r.cell WHERE (o.blat, o.blon) <> (f.lat, f.lon))"""


@query(f"WITH {RING_SQL} SELECT cell, pos, lat, lon FROM ring")
def hull(spark, sf_dir):
    """Corners of the convex hulls of 25 groups of points."""
    h = spatial.hulls(_grouped(spark, sf_dir), "cell")
    return h.select("cell", F.posexplode("ring").alias("pos", "p")).select("cell", F.col("pos").cast("long").alias("pos"), F.col("p.lat").cast("long").alias("lat"), F.col("p.lon").cast("long").alias("lon"))


@query(f"WITH {OUTER_SQL} SELECT cell, count(DISTINCT (lat, lon)) AS corners FROM outer_edges GROUP BY cell")
def hull_corners(spark, sf_dir):
    """Numbers of hull corners."""
    return spatial.hulls(_grouped(spark, sf_dir), "cell").select("cell", F.size("ring").cast("long").alias("corners"))


_FEATURE = "type string, id bigint, bbox array<double>, geometry struct<type: string, coordinates: array<array<array<double>>>>"


@query(f"""WITH {RING_SQL}, b AS (SELECT cell, min(lon) / 1e6 AS west, min(lat) / 1e6 AS south, max(lon) / 1e6 AS east, max(lat) / 1e6 AS north FROM ring GROUP BY cell),
closed AS (SELECT cell, pos, lat, lon FROM ring UNION ALL SELECT cell, (SELECT count(*) FROM ring r WHERE r.cell = f.cell), lat, lon FROM ring f WHERE pos = 0)
SELECT 'Feature/Polygon' AS kind, cell, west, south, east, north, pos, lon / 1e6 AS x, lat / 1e6 AS y FROM closed JOIN b USING (cell)""")
def hull_geojson(spark, sf_dir):
    """The hulls as GeoJSON polygons, read back: kind, box and the corners of the closed ring."""
    f = polygon_features(spatial.hulls(_grouped(spark, sf_dir), "cell")).select("cell", F.from_json("feature", _FEATURE).alias("f"))
    rows = f.select(F.concat_ws("/", "f.type", "f.geometry.type").alias("kind"), F.col("f.id").alias("cell"), *(F.col("f.bbox")[i].alias(n) for i, n in enumerate(("west", "south", "east", "north"))), F.posexplode(F.col("f.geometry.coordinates")[0]).alias("pos", "p"))
    return rows.select("kind", "cell", "west", "south", "east", "north", F.col("pos").cast("long").alias("pos"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query(f"""WITH {RING_SQL}, b AS (SELECT cell, (min(lat) + (max(lat) - min(lat)) // 2)::BIGINT AS lat, (min(lon) + (max(lon) - min(lon)) // 2)::BIGINT AS lon, min(lon) / 1e6 AS west, max(lat) / 1e6 AS north FROM ring GROUP BY cell),
u AS (SELECT *, (lat + 4294967296) % 4294967296 AS a, lon + 2147483648 AS b FROM b),
m AS (SELECT cell, west, north, (SELECT sum(((b >> i) & 1)::HUGEINT * pow(2, 2 * i)::HUGEINT + ((a >> i) & 1)::HUGEINT * pow(2, 2 * i + 1)::HUGEINT) FROM range(0, 32) t(i)) AS z FROM u)
SELECT cell, west, north, row_number() OVER (ORDER BY CASE WHEN z >= 9223372036854775808 THEN z - 18446744073709551616 ELSE z END, cell) - 1 AS place FROM m""")
def hull_places(spark, sf_dir):
    """Hulls with their boxes, in the order in which exports list them."""
    h = spatial.hull_boxes(spatial.hulls(_grouped(spark, sf_dir), "cell"))
    return h.select("cell", F.col("bbox")[0].alias("west"), F.col("bbox")[3].alias("north"), "place")


@query(f"""WITH {GEO_SQL}, {COPURCHASE_SQL} SELECT 'Feature/Point' AS kind, src AS id, lon / 1e6 AS x, lat / 1e6 AS y FROM copurchase JOIN geo ON id = src WHERE src % 4 <> dst % 4""")
def boundary_geojson(spark, sf_dir):
    """A GeoJSON point for the start of every arc between two partitions, read back."""
    e = copurchase(spark, sf_dir)
    part = e.selectExpr("explode(array(src, dst)) AS node").distinct().selectExpr("node", "node % 4 AS partition_id")
    f = point_features(boundary_points(e, part, geo(spark, sf_dir))).select(F.from_json("feature", "type string, id bigint, geometry struct<type: string, coordinates: array<double>>").alias("f"))
    return f.select(F.concat_ws("/", "f.type", "f.geometry.type").alias("kind"), "f.id", F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"))


def _planar(spark, sf_dir):
    """All customers, a hundred consecutive keys a cell: more customers give more cells."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey div 100 AS cell", "c_custkey AS id", "cast((c_custkey * 7919) % 1009 AS double) AS x", "cast((c_custkey * 104729) % 1013 AS double) AS y")


#: Triangles of a cell whose circle holds no other point: each from its smallest id in turning order. Exact, in integers;
#: a few points turn most triangles away before all are asked.
_IN_CIRCLE = """EXISTS (SELECT 1 FROM p d WHERE d.cell = {t}.cell AND {few} AND
  ((ax - d.x) * (ax - d.x) + (ay - d.y) * (ay - d.y)) * ((bx - d.x) * (cy - d.y) - (cx - d.x) * (by_ - d.y)) - ((bx - d.x) * (bx - d.x) + (by_ - d.y) * (by_ - d.y)) * ((ax - d.x) * (cy - d.y) - (cx - d.x) * (ay - d.y))
  + ((cx - d.x) * (cx - d.x) + (cy - d.y) * (cy - d.y)) * ((ax - d.x) * (by_ - d.y) - (bx - d.x) * (ay - d.y)) > 0)"""
DELAUNAY_SQL = f"""p AS MATERIALIZED (SELECT c_custkey // 100 AS cell, c_custkey AS id, ((c_custkey * 7919) % 1009)::BIGINT AS x, ((c_custkey * 104729) % 1013)::BIGINT AS y FROM customer),
t AS (SELECT a.cell, a.id AS a, CASE WHEN turn > 0 THEN b.id ELSE c.id END AS b, CASE WHEN turn > 0 THEN c.id ELSE b.id END AS c, a.x AS ax, a.y AS ay,
    CASE WHEN turn > 0 THEN b.x ELSE c.x END AS bx, CASE WHEN turn > 0 THEN b.y ELSE c.y END AS by_, CASE WHEN turn > 0 THEN c.x ELSE b.x END AS cx, CASE WHEN turn > 0 THEN c.y ELSE b.y END AS cy
  FROM p a JOIN p b ON b.cell = a.cell AND b.id > a.id JOIN p c ON c.cell = a.cell AND c.id > b.id, LATERAL (SELECT (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn) WHERE turn <> 0),
u AS MATERIALIZED (SELECT * FROM t WHERE NOT {_IN_CIRCLE.format(t="t", few="d.id % 25 = 0")}), v AS MATERIALIZED (SELECT * FROM u WHERE NOT {_IN_CIRCLE.format(t="u", few="d.id % 5 = 1")}),
tri AS MATERIALIZED (SELECT * FROM v WHERE NOT {_IN_CIRCLE.format(t="v", few="true")})"""


@query(f"WITH {DELAUNAY_SQL} SELECT cell, a, b, c FROM tri")
def delaunay(spark, sf_dir):
    return spatial.delaunay(_planar(spark, sf_dir), "cell")


@query(f"""WITH {DELAUNAY_SQL}, sized AS (SELECT *, sqrt(((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))::DOUBLE) * sqrt(((bx - cx) * (bx - cx) + (by_ - cy) * (by_ - cy))::DOUBLE) * sqrt(((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay))::DOUBLE)
  / (2 * abs((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax))) AS radius FROM tri),
sides AS (SELECT cell, unnest([ax, bx, cx]) AS x, unnest([ay, by_, cy]) AS y, unnest([bx, cx, ax]) AS u, unnest([by_, cy, ay]) AS v FROM sized WHERE radius <= 150)
SELECT cell, x::DOUBLE AS x, y::DOUBLE AS y, u::DOUBLE AS u, v::DOUBLE AS v FROM sides s WHERE NOT EXISTS (SELECT 1 FROM sides o WHERE o.cell = s.cell AND o.x = s.u AND o.y = s.v AND o.u = s.x AND o.v = s.y)""")
def alpha_shape(spark, sf_dir):
    """The sides of the alpha shapes, from point to point along their rings."""
    r = spatial.alpha_shapes(_planar(spark, sf_dir), "cell", 150.0)
    after = r.groupBy("cell", "ring").agg(F.max("pos").alias("last"))
    nxt = r.selectExpr("cell", "ring", "pos AS follow", "x AS u", "y AS v")
    linked = r.join(after, ["cell", "ring"]).withColumn("follow", F.expr("IF(pos = last, 0, pos + 1)")).join(nxt, ["cell", "ring", "follow"])
    return linked.select("cell", "x", "y", "u", "v")


@query(f"WITH {GEO_SQL} SELECT id % 4 AS partition_id, lat / 1e6 AS latitude, lon / 1e6 AS longitude FROM geo")
def assignment_csv(spark, sf_dir):
    g = geo(spark, sf_dir)
    return assignment(g.selectExpr("id AS node", "id % 4 AS partition_id"), g)


DIST_SQL = "d AS (SELECT k AS instance, i, j, CASE WHEN i = j THEN 0 ELSE 1 + (least(i, j) * 7 + greatest(i, j) * 11 + k * 5 + least(i, j) * greatest(i, j)) % 17 END AS w FROM range(0, 4) a(k), range(0, 8) b(i), range(0, 8) c(j))"


def _dist(spark):
    w = "CASE WHEN i = j THEN 0L ELSE 1 + (least(i, j) * 7 + greatest(i, j) * 11 + k * 5 + least(i, j) * greatest(i, j)) % 17 END"
    return spark.range(256).selectExpr("id div 64 AS k", "(id div 8) % 8 AS i", "id % 8 AS j").selectExpr("k AS instance", "i", "j", f"{w} AS w")


@query(f"""WITH RECURSIVE {DIST_SQL}, t(instance, mask, last, cost) AS (SELECT instance, 1 << j, j, w FROM d WHERE i = 0 AND j > 0
  UNION ALL SELECT t.instance, t.mask | (1 << d.j), d.j, t.cost + d.w FROM t JOIN d ON d.instance = t.instance AND d.i = t.last AND d.j > 0 AND t.mask & (1 << d.j) = 0)
SELECT t.instance, min(t.cost + d.w)::BIGINT AS cost FROM t JOIN d ON d.instance = t.instance AND d.i = t.last AND d.j = 0 WHERE t.mask = 254 GROUP BY t.instance""")
def tsp_dp(spark, sf_dir):
    return tours.held_karp(_dist(spark), 8)


@query(ORACLE_SQL["tsp_dp"])
def tsp_brute_force(spark, sf_dir):
    return tours.tours(_dist(spark), "brute_force").select("instance", "cost")


@query(f"""WITH RECURSIVE {DIST_SQL}, t(instance, mask, here, cost, tour) AS (SELECT k, 1, 0, 0::BIGINT, [0] FROM range(0, 4) a(k)
  UNION ALL SELECT instance, mask | (1 << j), j, (cost + w)::BIGINT, list_append(tour, j) FROM (SELECT t.*, d.j, d.w, row_number() OVER (PARTITION BY t.instance ORDER BY d.w, d.j) AS r FROM t JOIN d ON d.instance = t.instance AND d.i = t.here AND t.mask & (1 << d.j) = 0) WHERE r = 1)
SELECT t.instance, (t.cost + d.w)::BIGINT AS cost, array_to_string(t.tour, ',') AS tour FROM t JOIN d ON d.instance = t.instance AND d.i = t.here AND d.j = 0 WHERE t.mask = 255""")
def tsp_nn(spark, sf_dir):
    return tours.tours(_dist(spark)).select("instance", "cost", F.array_join("tour", ",").alias("tour"))


PRIM_SQL = """t(instance, mask, cost) AS (SELECT k, {start}, 0::BIGINT FROM range(0, 4) a(k)
  UNION ALL SELECT instance, mask | (1 << j), (cost + w)::BIGINT FROM (SELECT t.*, d.j, d.w, row_number() OVER (PARTITION BY t.instance ORDER BY d.w, d.j) AS r FROM t JOIN d ON d.instance = t.instance AND t.mask & (1 << d.i) > 0 AND t.mask & (1 << d.j) = 0) WHERE r = 1)
SELECT instance, cost FROM t WHERE mask = 255"""


@query(f"WITH RECURSIVE {DIST_SQL}, {PRIM_SQL.format(start=1)}")
def prim_mst(spark, sf_dir):
    return tours.spanning_trees(_dist(spark)).select("instance", "cost")


@query(f"WITH RECURSIVE {DIST_SQL}, {PRIM_SQL.format(start=7)}")
def prim_fixed_subtour(spark, sf_dir):
    """Spanning trees that start with nodes 0, 1 and 2 joined."""
    return tours.spanning_trees(_dist(spark), [0, 1, 2]).select("instance", "cost")


@query("SELECT n_regionkey::BIGINT AS instance, a.n_nationkey::BIGINT AS i, b.n_nationkey::BIGINT AS j, round(sqrt(pow((a.n_nationkey * 37 % 101) - (b.n_nationkey * 37 % 101), 2) + pow((a.n_nationkey * 53 % 97) - (b.n_nationkey * 53 % 97), 2)))::BIGINT AS w FROM nation a JOIN nation b USING (n_regionkey)")
def complete_graph(spark, sf_dir):
    """Planar distances between the nations of a region."""
    s = table(spark, sf_dir, "nation").selectExpr("cast(n_regionkey AS bigint) AS instance", "cast(n_nationkey AS bigint) AS id", "n_nationkey * 37 % 101 AS x", "n_nationkey * 53 % 97 AS y")
    return graphs.complete_graph(s)
