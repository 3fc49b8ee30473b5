"""Scalar functions over coordinates and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import bits as B
from roadloom.functions import boxes as X
from roadloom.functions import encoders as E
from roadloom.functions import geo as G
from roadloom.functions import sql as S
from roadloom.queries.registry import registry
from roadloom.sources.derived import GEO_SQL, geo, table

QUERIES, ORACLE_SQL, query = registry()

PI, R = "pi()", "6378.137"


def _pairs(spark, sf_dir):
    """Neighbouring points by id: id, a, b, c, d in degrees."""
    g = geo(spark, sf_dir).selectExpr("id", "lat / 1e6 AS a", "lon / 1e6 AS b")
    return g.join(g.selectExpr("id - 1 AS id", "a AS c", "b AS d"), "id")


PAIRS = f"{GEO_SQL}, pairs AS (SELECT x.id, x.lat / 1e6 AS a, x.lon / 1e6 AS b, y.lat / 1e6 AS c, y.lon / 1e6 AS d FROM geo x JOIN geo y ON y.id = x.id + 1)"
HAVERSINE = f"2 * {R} * atan2(sqrt(pow(sin(radians({{c}} - {{a}}) / 2), 2) + cos(radians({{a}})) * cos(radians({{c}})) * pow(sin(radians({{b}} - {{d}}) / 2), 2)), sqrt(greatest(1 - (pow(sin(radians({{c}} - {{a}}) / 2), 2) + cos(radians({{a}})) * cos(radians({{c}})) * pow(sin(radians({{b}} - {{d}}) / 2), 2)), 0.0)))"


@query(f"WITH {PAIRS} SELECT id, round({HAVERSINE.format(a='a', b='b', c='c', d='d')}, 6) AS km FROM pairs")
def haversine_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(G.haversine(*map(F.col, "abcd")), 6).alias("km"))


@query(f"""WITH {PAIRS} SELECT id, round({R} * atan2(sqrt(pow(cos(radians(c)) * sin(abs(radians(b) - radians(d))), 2)
  + pow(cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(abs(radians(b) - radians(d))), 2)),
  sin(radians(a)) * sin(radians(c)) + cos(radians(a)) * cos(radians(c)) * cos(abs(radians(b) - radians(d)))), 6) AS km FROM pairs""")
def vincenty_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(G.vincenty(*map(F.col, "abcd")), 6).alias("km"))


_Y = f"degrees(0.5) * ln((1 + sin(radians(greatest(least(lat / 1e6, {G.MAX_LATITUDE}), -{G.MAX_LATITUDE})))) / (1 - sin(radians(greatest(least(lat / 1e6, {G.MAX_LATITUDE}), -{G.MAX_LATITUDE})))))"


@query(f"""WITH {GEO_SQL}, p AS (SELECT id, lon / 1e6 * {R} * 1000 * {PI} / 180 AS x, {_Y} AS y FROM geo)
SELECT id, round(x, 4) AS x, round(y, 6) AS y, round(x * 180 / ({R} * 1000 * {PI}), 6) AS lon, round(degrees(2.0) * atan(exp(radians(greatest(least(y, 180), -180)))) - 90, 6) AS lat, round(y, 6) AS approx FROM p""")
def mercator_xy(spark, sf_dir):
    """Projection, its inverse, and the approximation, which agrees with the exact value to six digits."""
    g = geo(spark, sf_dir).selectExpr("id", "lat / 1e6 AS lat", "lon / 1e6 AS lon")
    x, y = G.lon_to_x(F.col("lon")), G.lat_to_y(F.col("lat"))
    return g.select("id", F.round(x, 4).alias("x"), F.round(y, 6).alias("y"), F.round(G.x_to_lon(x), 6).alias("lon"), F.round(G.y_to_lat(y), 6).alias("lat"), F.round(G.lat_to_y_approx(F.col("lat")), 6).alias("approx"))


_TILE_Y = f"16384 * (1 - ln(tan(radians(lat / 1e6)) + 1 / cos(radians(lat / 1e6))) / {PI}) / 2"


@query(f"WITH {GEO_SQL} SELECT id, greatest(trunc(16384 * (lon / 1e6 + 180) / 360), 0)::BIGINT AS x, greatest(trunc({_TILE_Y}), 0)::BIGINT AS y FROM geo WHERE abs(lat) <= 85000000")
def tile_numbers(spark, sf_dir):
    g = geo(spark, sf_dir).where("abs(lat) <= 85000000").select("id", G.degrees(F.col("lat")).alias("lat"), G.degrees(F.col("lon")).alias("lon"))
    return g.select("id", G.tile_x(F.col("lon"), 14).alias("x"), G.tile_y(F.col("lat"), 14).alias("y"))


@query(f"""SELECT c_custkey AS id, round(x / 1024.0 * 360 - 180, 6) AS west, round(degrees(atan(sinh({PI} * (1 - 2 * y / 1024.0)))), 6) AS north,
  round((x + 1) / 1024.0 * 360 - 180, 6) AS east, round(degrees(atan(sinh({PI} * (1 - 2 * (y + 1) / 1024.0)))), 6) AS south
FROM (SELECT c_custkey, c_custkey * 37 % 1024 AS x, c_custkey * 101 % 1024 AS y FROM customer)""")
def tile_bounds(spark, sf_dir):
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey * 37 % 1024 AS x", "c_custkey * 101 % 1024 AS y")
    x, y = F.col("x"), F.col("y")
    return t.select("id", F.round(G.tile_west(x, 10), 6).alias("west"), F.round(G.tile_north(y, 10), 6).alias("north"), F.round(G.tile_west(x + 1, 10), 6).alias("east"), F.round(G.tile_north(y + 1, 10), 6).alias("south"))


@query(f"""WITH {GEO_SQL}, p AS (SELECT id, lon, lat, 2097152.0 * (1 + lon / 1e6 / 180) AS px, 2097152.0 * (1 - ({_Y}) / 180) AS py FROM geo)
SELECT id, round(px, 4) AS px, round(py, 4) AS py, round((px - 2097152) / 4194304 * 360, 6) AS lon,
  round(degrees(2.0) * atan(exp(radians(greatest(least(degrees({PI} * (1 - 2 * (py / 4194304))), 180), -180)))) - 90, 6) AS lat FROM p""")
def pixel_coords(spark, sf_dir):
    g = geo(spark, sf_dir).select("id", G.degrees(F.col("lat")).alias("lat"), G.degrees(F.col("lon")).alias("lon"))
    px, py = G.pixel_x(F.col("lon"), 10), G.pixel_y(F.col("lat"), 10)
    return g.select("id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"), F.round(G.pixel_to_lon(px, 4194304.0), 6).alias("lon"), F.round(G.pixel_to_lat(py, 4194304.0), 6).alias("lat"))


_Y_OF = f"(degrees(0.5) * ln((1 + sin(radians(greatest(least({{v}}, {G.MAX_LATITUDE}), -{G.MAX_LATITUDE})))) / (1 - sin(radians(greatest(least({{v}}, {G.MAX_LATITUDE}), -{G.MAX_LATITUDE}))))))"


@query(f"""WITH {GEO_SQL}, p AS (SELECT id, lat / 1e6 AS a, lon / 1e6 AS b FROM geo WHERE abs(lat) <= 85000000),
t AS (SELECT *, trunc(256 * (b + 180) / 360) AS tx, trunc(256 * (1 - ln(tan(radians(a)) + 1 / cos(radians(a))) / {PI}) / 2) AS ty FROM p),
e AS (SELECT *, tx / 256 * 360 - 180 AS west, (tx + 1) / 256 * 360 - 180 AS east, degrees(atan(sinh({PI} * (1 - 2 * ty / 256)))) AS north, degrees(atan(sinh({PI} * (1 - 2 * (ty + 1) / 256)))) AS south FROM t)
SELECT id, least(greatest(trunc((b - west) * 4095 / (east - west)), 0), 4095)::BIGINT AS x,
  least(greatest(trunc(({_Y_OF.format(v='a')} - {_Y_OF.format(v='north')}) * 4095 / ({_Y_OF.format(v='south')} - {_Y_OF.format(v='north')})), 0), 4095)::BIGINT AS y FROM e""")
def linestring_tile(spark, sf_dir):
    """Every point inside its own tile, 0 to 4095."""
    g = geo(spark, sf_dir).where("abs(lat) <= 85000000").select("id", G.degrees(F.col("lat")).alias("lat"), G.degrees(F.col("lon")).alias("lon"))
    x, y = G.in_tile(F.col("lat"), F.col("lon"), 8, G.tile_x(F.col("lon"), 8), G.tile_y(F.col("lat"), 8))
    return g.select("id", x.alias("x"), y.alias("y"))


@query("SELECT o_orderkey AS id, (xor(v * 2, CASE WHEN v < 0 THEN -1 ELSE 0 END) & 4294967295)::BIGINT AS z FROM (SELECT o_orderkey, (o_orderkey * 7919) % 2000003 - 1000001 AS v FROM orders)")
def zigzag(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), B.zigzag((F.col("o_orderkey") * 7919) % 2000003 - 1000001).alias("z"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN 0 ELSE pow(2, floor(log2(p_partkey)))::BIGINT END AS power,
  (SELECT min(i) FROM range(0, 40) t(i) WHERE (p_partkey >> i) & 1 = 1)::BIGINT AS low, bit_count(p_partkey)::BIGINT AS ones,
  ((xor(p_partkey, p_partkey >> 16) * 2654435769) & 4294967295) >> 16 AS hash FROM part""")
def bit_functions(spark, sf_dir):
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(p.alias("id"), B.prev_power_of_two(p).alias("power"), B.lowest_set_bit(p).alias("low"), F.size(B.set_bits(p)).cast("long").alias("ones"), B.fibonacci_hash(p).alias("hash"))


@query("""WITH RECURSIVE pascal(n, row) AS (SELECT 0, [1::HUGEINT] UNION ALL
  SELECT n + 1, list_concat([1::HUGEINT], list_transform(generate_series(1, len(row)), lambda i: row[i] + coalesce(row[i + 1], 0))) FROM pascal WHERE n < 60)
SELECT n::BIGINT AS n, k::BIGINT AS k, row[k + 1]::VARCHAR AS value FROM pascal, range(0, 21) t(k) WHERE k <= n""")
def binomials(spark, sf_dir):
    rows = spark.range(0, 61).withColumnRenamed("id", "n").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(20).cast("long")))))
    return rows.select("n", "k", B.choose(F.col("n"), F.col("k")).cast("string").alias("value"))


@query("""SELECT p_partkey AS id, (3 * x * x * x - 2 * x * x + x - 7)::BIGINT AS value FROM (SELECT p_partkey, (p_partkey % 100) AS x FROM part)""")
def horner(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), G.polynomial((3.0, -2.0, 1.0, -7.0), (F.col("p_partkey") % 100).cast("double")).cast("long").alias("value"))


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey + 1 AS a, (c_custkey * 31) % 1021 + 1 AS b FROM customer), l AS (
  SELECT *, floor(log2(a))::BIGINT AS la, floor(log2(b))::BIGINT AS lb FROM p), s AS (
  SELECT *, a >> greatest(la - lb, 0) AS x, b >> greatest(lb - la, 0) AS y FROM l)
SELECT id, greatest(a >> 1, 1) AS parent, a & ~7::BIGINT AS at_three, a * 2 AS lhs, a * 2 + 1 AS rhs, a << 3 AS leftmost, (a << 3) + 7 AS rightmost, la AS level, a % 2 = 0 AS is_left,
  x >> (SELECT min(i) FROM range(0, 40) t(i) WHERE x >> i = y >> i) AS lca, (a >> 2) & 1 = 1 AS bit FROM s""")
def partition_id_ops(spark, sf_dir):
    a, b, three = F.col("a"), F.col("b"), F.lit(3)
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey + 1 AS a", "(c_custkey * 31) % 1021 + 1 AS b")
    return t.select("id", B.parent(a).alias("parent"), B.parent_at_level(a, three).alias("at_three"), B.left_child(a).alias("lhs"), B.right_child(a).alias("rhs"), B.leftmost_descendant(a, three).alias("leftmost"), B.rightmost_descendant(a, three).alias("rightmost"), B.level(a).alias("level"), B.is_left_child(a).alias("is_left"), B.lowest_common_ancestor(a, b).alias("lca"), B.extract_bit(a, F.lit(2)).alias("bit"))


@query("""WITH p AS (SELECT c_custkey AS id, (c_custkey * 13 % 50)::DOUBLE AS px, (c_custkey * 7 % 40)::DOUBLE AS py, (c_custkey % 9)::DOUBLE AS ax, (c_custkey % 5)::DOUBLE AS ay, (c_custkey % 11 + 5)::DOUBLE AS bx, (c_custkey % 3)::DOUBLE AS by_ FROM customer),
t AS (SELECT *, CASE WHEN pow(bx - ax, 2) + pow(by_ - ay, 2) = 0 THEN 0 ELSE least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)), 0), 1) END AS t FROM p)
SELECT id, round(sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2)), 6) AS distance, round(ax + t * (bx - ax), 6) AS x, round(ay + t * (by_ - ay), 6) AS y,
  ((ax - px) * (by_ - py) - (ay - py) * (bx - px))::BIGINT AS turn, round(sqrt(pow(px - bx, 2) + pow(py - by_, 2)))::BIGINT AS planar FROM t""")
def segment_geometry(spark, sf_dir):
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", *(f"cast({e} AS double) AS {n}" for n, e in (("px", "c_custkey * 13 % 50"), ("py", "c_custkey * 7 % 40"), ("ax", "c_custkey % 9"), ("ay", "c_custkey % 5"), ("bx", "c_custkey % 11 + 5"), ("by_", "c_custkey % 3"))))
    px, py, ax, ay, bx, by = (F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by_"))
    s = t.withColumn("s", G.segment_distance(px, py, ax, ay, bx, by))
    return s.select("id", F.round("s.distance", 6).alias("distance"), F.round("s.x", 6).alias("x"), F.round("s.y", 6).alias("y"), G.cross_product(px, py, ax, ay, bx, by).alias("turn"), G.euclidean_2d(px, py, bx, by).alias("planar"))


@query(f"""WITH {GEO_SQL}, w AS (SELECT n_nationkey, n_nationkey * 6000000 - 80000000 AS lo_lat, n_nationkey * 12000000 - 170000000 AS lo_lon FROM nation)
SELECT id, n_nationkey::BIGINT AS box_id, lat BETWEEN lo_lat AND lo_lat + 20000000 AND lon BETWEEN lo_lon AND lo_lon + 30000000 AS inside,
  (lo_lat + 10000000)::BIGINT AS center_lat, (lo_lon + 15000000)::BIGINT AS center_lon,
  least(greatest(lat, lo_lat), lo_lat + 20000000)::BIGINT AS near_lat, least(greatest(lon, lo_lon), lo_lon + 30000000)::BIGINT AS near_lon FROM geo JOIN w ON id % 25 = n_nationkey""")
def box_functions(spark, sf_dir):
    """Membership, centre and nearest point of boxes."""
    w = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("box_id"), X.box(*(F.expr(e) for e in ("n_nationkey * 6000000 - 80000000", "n_nationkey * 12000000 - 170000000", "n_nationkey * 6000000 - 60000000", "n_nationkey * 12000000 - 140000000"))).alias("box"))
    g = geo(spark, sf_dir).withColumn("box_id", F.col("id") % 25).join(F.broadcast(w), "box_id")
    b, lat, lon = F.col("box"), F.col("lat"), F.col("lon")
    (c_lat, c_lon), (n_lat, n_lon) = X.center(b), X.nearest_point(b, lat, lon)
    return g.select("id", "box_id", X.contains(b, lat, lon).alias("inside"), c_lat.alias("center_lat"), c_lon.alias("center_lon"), n_lat.alias("near_lat"), n_lon.alias("near_lon"))


_BOXED = f"""{GEO_SQL}, b AS (SELECT x.id, least(x.lat, y.lat) AS a, least(x.lon, y.lon) AS b, greatest(x.lat, y.lat) AS c, greatest(x.lon, y.lon) AS d, z.lat AS e, z.lon AS f, z.lat + (x.id % 3 - 1) * 900000 AS g, z.lon + 7000000 AS h
  FROM geo x JOIN geo y ON y.id = x.id + 1 JOIN geo z ON z.id = x.id + 2)"""


@query(f"""WITH {_BOXED}, n AS (SELECT *, least(greatest(e, a), c) AS ne, least(greatest(f, b), d) AS nf FROM b)
SELECT id, e <= g AND f <= h AS valid, a <= g AND e <= c AND b <= h AND f <= d AS met, least(a, e)::BIGINT AS south, greatest(d, h)::BIGINT AS east, round(sqrt((ne - e)::DOUBLE * (ne - e) + (nf - f)::DOUBLE * (nf - f)), 2) AS planar,
  round(CASE WHEN ne = e AND nf = f THEN 0 ELSE {HAVERSINE.format(a='(ne / 1e6)', b='(nf / 1e6)', c='(e / 1e6)', d='(f / 1e6)')} END, 6) AS km, b / 1e6 AS west FROM n""")
def box_pairs(spark, sf_dir):
    """Boxes of neighbouring points against others: validity, contact, union, and the distance to a point in both metrics."""
    g = geo(spark, sf_dir)
    y, z = (g.selectExpr(f"id - {k} AS id", f"lat AS {n}_lat", f"lon AS {n}_lon") for k, n in ((1, "y"), (2, "z")))
    rows = g.join(y, "id").join(z, "id")
    corner = X.point_box(F.col("y_lat"), F.col("y_lon"))
    a = X.merged(X.point_box(F.col("lat"), F.col("lon")), corner)
    b = X.box(F.col("z_lat"), F.col("z_lon"), F.col("z_lat") + (F.col("id") % 3 - 1) * 900000, F.col("z_lon") + 7000000)
    rows = rows.withColumn("a", a).withColumn("b", b)
    a, b, point = F.col("a"), F.col("b"), (F.col("z_lat"), F.col("z_lon"))
    both = X.merged(a, b)
    return rows.select("id", X.is_valid(b).alias("valid"), X.intersects(a, b).alias("met"), both["min_lat"].alias("south"), both["max_lon"].alias("east"), F.round(X.Planar.min_distance(a, *point), 2).alias("planar"), F.round(X.Haversine.min_distance(a, *point), 6).alias("km"), X.geojson_bbox(a)[0].alias("west"))


@query(f"WITH {GEO_SQL} SELECT id, printf('%.6f, %.6f', lat / 1e6, lon / 1e6) AS text, lon / 1e6 AS first, trunc(((id * 7919) % 180000 / 1000.0::DOUBLE - 90) * 1e6)::BIGINT AS fixed, greatest(least(lat / 1e5, {G.MAX_LATITUDE}), -{G.MAX_LATITUDE}) AS lat_cut, greatest(least(lon / 1e5, 180.0), -180.0) AS lon_cut FROM geo")
def coordinate_text(spark, sf_dir):
    """Text, pairs, fixed-point and clamped forms of coordinates."""
    lat, lon = F.col("lat"), F.col("lon")
    fixed = G.fixed_point(F.expr("cast((id * 7919) % 180000 AS double) / 1000.0D - 90"))
    return geo(spark, sf_dir).select("id", X.display(lat, lon).alias("text"), X.lon_lat(lat, lon)[0].alias("first"), fixed.cast("long").alias("fixed"), G.clamp_lat(lat / 1e5).alias("lat_cut"), G.clamp_lon(lon / 1e5).alias("lon_cut"))


@query("""WITH RECURSIVE h(id, x, y, d, k) AS (SELECT c_custkey, (c_custkey * 7919) % 65536, (c_custkey * 104729) % 65536, 0::BIGINT, 15 FROM customer
  UNION ALL SELECT id, CASE WHEN up THEN x & (side - 1) WHEN east THEN side - 1 - (y & (side - 1)) ELSE y & (side - 1) END, CASE WHEN up THEN y & (side - 1) WHEN east THEN side - 1 - (x & (side - 1)) ELSE x & (side - 1) END,
    d + side * side * CASE WHEN east AND NOT up THEN 3 WHEN east THEN 2 WHEN up THEN 1 ELSE 0 END, k - 1
  FROM (SELECT *, 1::BIGINT << k AS side, x & (1::BIGINT << k) > 0 AS east, y & (1::BIGINT << k) > 0 AS up FROM h WHERE k >= 0))
SELECT id, d AS place FROM h WHERE k = -1""")
def hilbert_places(spark, sf_dir):
    """Places of points along the Hilbert curve."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), B.hilbert_index((F.col("c_custkey") * 7919) % 65536, (F.col("c_custkey") * 104729) % 65536).alias("place"))


@query(f"""WITH {GEO_SQL}, u AS (SELECT id, lat, lon, (lat + 4294967296) % 4294967296 AS a, lon + 2147483648 AS b FROM geo),
m AS (SELECT id, (SELECT sum(((b >> i) & 1)::HUGEINT * pow(2, 2 * i)::HUGEINT + ((a >> i) & 1)::HUGEINT * pow(2, 2 * i + 1)::HUGEINT) FROM range(0, 32) t(i)) AS z FROM u)
SELECT id, row_number() OVER (ORDER BY CASE WHEN z >= 9223372036854775808 THEN z - 18446744073709551616 ELSE z END, id) AS pos FROM m""")
def zorder_sort(spark, sf_dir):
    """Positions along the Z-order curve."""
    from roadloom.operators.relational import global_prefix_sums

    g = geo(spark, sf_dir).select("id", F.struct(G.zorder_key(F.col("lat"), F.col("lon")).alias("z"), "id").alias("k"), F.lit(1).cast("long").alias("one"))
    return global_prefix_sums(g, "k", "one", 8).select("id", F.col("prefix").alias("pos"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey % 4096 AS x, floor(o_totalprice % 4096)::BIGINT AS y, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n,
  lag(o_orderkey % 4096, 1, 0) OVER w AS px, lag(floor(o_totalprice % 4096)::BIGINT, 1, 0) OVER w AS py FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
z AS (SELECT o_custkey, k, n, CASE WHEN x >= px THEN 2 * (x - px) ELSE -2 * (x - px) - 1 END AS dx, CASE WHEN y >= py THEN 2 * (y - py) ELSE -2 * (y - py) - 1 END AS dy FROM o)
SELECT o_custkey, array_to_string(flatten(list(CASE WHEN k = 1 THEN [9, dx, dy] WHEN k = 2 THEN [2 + 8 * (n - 1), dx, dy] ELSE [dx, dy] END ORDER BY k))::BIGINT[], ',') AS stream FROM z GROUP BY o_custkey""")
def mvt_lines(spark, sf_dir):
    """Vector-tile streams of each customer's orders as a line."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") % 4096).cast("long").alias("y")))).alias("p"))
    stream = E.geometry(F.transform("p", lambda p: p["o_orderkey"] % 4096), F.transform("p", lambda p: p["y"]))
    return o.select("o_custkey", F.array_join(stream.cast("array<string>"), ",").alias("stream"))


_POLYLINE = """WITH p AS (SELECT o_custkey AS id, row_number() OVER w AS k, (o_orderkey % 1700) * 0.05 - 42.5 AS lat, (o_orderkey * 31 % 3400) * 0.05 - 85 AS lon FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r AS (SELECT id, k, round(lat * 1e5)::BIGINT AS lat, round(lon * 1e5)::BIGINT AS lon FROM p),
d AS (SELECT id, k, lat - lag(lat, 1, 0) OVER w AS a, lon - lag(lon, 1, 0) OVER w AS b FROM r WINDOW w AS (PARTITION BY id ORDER BY k)),
v AS (SELECT id, k, j, CASE WHEN x < 0 THEN -2 * x - 1 ELSE 2 * x END AS z FROM (SELECT id, k, unnest([0, 1]) AS j, unnest([a, b]) AS x FROM d)),
c AS (SELECT id, k, j, z, CASE WHEN z = 0 THEN 1 ELSE floor(log2(z) / 5)::BIGINT + 1 END AS n FROM v),
t AS (SELECT id, k, j, array_to_string(list_transform(range(n), lambda i: chr((((z >> (5 * i)) & 31) + CASE WHEN i < n - 1 THEN 32 ELSE 0 END + 63)::INT)), '') AS s FROM c)"""


def _order_lines(spark, sf_dir):
    points = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    return points.selectExpr("id", "transform(o, x -> cast((x % 1700) * 0.05D - 42.5D AS double)) AS lats", "transform(o, x -> cast((x * 31 % 3400) * 0.05D - 85 AS double)) AS lons")


@query(f"{_POLYLINE} SELECT id, string_agg(s, '' ORDER BY k, j) AS line FROM t GROUP BY id")
def polyline_lines(spark, sf_dir):
    """Each customer's orders as the text of a line of many points."""
    return _order_lines(spark, sf_dir).select("id", E.polyline_encode(F.col("lats"), F.col("lons")).alias("line"))


@query("SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, round((o_orderkey % 1700) * 0.05 - 42.5, 5)::DOUBLE AS lat, round((o_orderkey * 31 % 3400) * 0.05 - 85, 5)::DOUBLE AS lon FROM orders")
def polyline_round_trip(spark, sf_dir):
    """The points of lines through polyline text and back."""
    text = _order_lines(spark, sf_dir).select("id", E.polyline_encode(F.col("lats"), F.col("lons")).alias("line"))
    p = text.select("id", F.posexplode(E.polyline_decode(F.col("line"))).alias("pos", "p"))
    return p.select("id", F.col("pos").cast("long").alias("pos"), F.round("p.lat", 5).alias("lat"), F.round("p.lon", 5).alias("lon"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey <= 536870911 THEN p_partkey * 8 + p_size % 8 END AS value, p_size::BIGINT % 8 AS command, p_partkey AS n, (SELECT coalesce(min(i), 0) FROM range(0, 40) t(i) WHERE ((p_partkey - 1) >> i) & 1 = 1)::BIGINT AS low FROM part""")
def mvt_commands(spark, sf_dir):
    """Command integers and back, and lowest set bits where zero gives zero."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 8).alias("c"))
    value = E.command_integer(F.col("c"), F.col("p_partkey"))
    back = E.command_and_count(value)
    return p.select(F.col("p_partkey").alias("id"), value.alias("value"), back["command"].alias("command"), back["count"].alias("n"), B.lowest_set_bit_or_zero(F.col("p_partkey") - 1).alias("low"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey % 512 AS x, o_orderkey * 7 % 512 AS y, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
d AS (SELECT *, x - lag(x, 1, 0) OVER w AS dx, y - lag(y, 1, 0) OVER w AS dy FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY k)),
z AS (SELECT o_custkey, k, n, CASE WHEN dx >= 0 THEN 2 * dx ELSE -2 * dx - 1 END AS zx, CASE WHEN dy >= 0 THEN 2 * dy ELSE -2 * dy - 1 END AS zy FROM d)
SELECT o_custkey, array_to_string(list_concat(flatten(list(CASE WHEN k = 1 THEN [9, zx, zy] WHEN k = 2 THEN [2 + 8 * (n - 1), zx, zy] ELSE [zx, zy] END ORDER BY k))::BIGINT[], [15]), ',') AS stream FROM z GROUP BY o_custkey""")
def mvt_rings(spark, sf_dir):
    """Vector-tile streams of each customer's orders as a closed ring."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("p"))
    stream = E.geometry(F.transform("p", lambda p: p % 512), F.transform("p", lambda p: p * 7 % 512), closed=True)
    return o.select("o_custkey", F.array_join(stream.cast("array<string>"), ",").alias("stream"))


@query("SELECT m.mask, s.i AS subset FROM (SELECT DISTINCT p_size::BIGINT AS mask FROM part) m, range(0, 64) s(i) WHERE s.i <= m.mask AND s.i & ~m.mask = 0")
def subsets(spark, sf_dir):
    masks = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("mask")).distinct()
    return masks.select("mask", F.explode(B.subsets(F.col("mask"))).alias("subset"))


@query("""WITH m AS (SELECT r_regionkey::BIGINT AS id, [r_regionkey + 1, 20 + r_regionkey, 33, 47 - r_regionkey, 60] AS bits FROM region)
SELECT id, (SELECT sum(1::BIGINT << b) FROM (SELECT unnest(bits) AS b))::BIGINT AS mask, list_sum(list_transform(range(5), lambda k: CASE WHEN (s >> k) & 1 = 1 THEN 1::BIGINT << bits[k + 1] ELSE 0 END))::BIGINT AS subset FROM m, range(32) t(s)""")
def wide_subsets(spark, sf_dir):
    """Subsets of masks with bits far apart, by the table function."""
    S.register(spark)
    table(spark, sf_dir, "region").selectExpr("cast(r_regionkey AS bigint) AS id", "shiftleft(1L, r_regionkey + 1) | shiftleft(1L, 20 + r_regionkey) | shiftleft(1L, 33) | shiftleft(1L, 47 - r_regionkey) | shiftleft(1L, 60) AS mask").createOrReplaceTempView("_roadloom_masks")
    return spark.sql("SELECT id, mask, subset FROM _roadloom_masks, LATERAL bit_subsets(mask)")


@query("""WITH v AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS idx FROM range(65536) b(x) WHERE bit_count(x) = 5) SELECT 5 AS weight, idx, x AS value FROM v WHERE idx < 300
UNION ALL SELECT 1, i, 1::BIGINT << i FROM range(63) t(i) UNION ALL SELECT 1, 63, -9223372036854775808""")
def weight_iterator(spark, sf_dir):
    """Words of one and of five set bits in order, by the table function; the 64 of one bit are all."""
    S.register(spark)
    return spark.sql("SELECT 5 AS weight, idx, value FROM weight_words(5, 300) UNION ALL SELECT 1, idx, value FROM weight_words(1, 300)")


@query(f"""WITH {PAIRS} SELECT id, round({HAVERSINE.format(a='a', b='b', c='c', d='d')}, 6) AS km, round(b * {R} * 1000 * {PI} / 180, 4) AS x, greatest(trunc(16384 * (b + 180) / 360), 0)::BIGINT AS tile, greatest((id + 1) >> 1, 1) AS parent, floor(log2(id + 1))::BIGINT AS level,
  pow(2, floor(log2(id)))::BIGINT AS power, CASE WHEN id % 2 = 0 THEN id * 2 ELSE id * 2 - 1 END AS zig FROM pairs WHERE id > 0""")
def sql_functions(spark, sf_dir):
    """Registered functions, called from SQL."""
    S.register(spark)
    _pairs(spark, sf_dir).createOrReplaceTempView("_roadloom_pairs")
    return spark.sql("""SELECT id, round(haversine_km(a, b, c, d), 6) AS km, round(mercator_x(b), 4) AS x, tile_column(b, 14) AS tile, partition_parent(id + 1) AS parent, partition_level(id + 1) AS level,
      prev_power_of_two(id) AS power, zigzag(CASE WHEN id % 2 = 0 THEN id ELSE -id END) AS zig FROM _roadloom_pairs WHERE id > 0""")


@query("SELECT p_partkey AS id, hex(encode(p_name)) AS bytes FROM part")
def text_bytes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.hex(B.as_bytes(F.col("p_name"))).alias("bytes"))
