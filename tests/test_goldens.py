"""Hand-worked values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import bits, encoders, geo
from roadloom.operators import coding, relational, sketches, spatial, tours
from roadloom.plans import batched, flow, frontier, hierarchy
from roadloom.sources import formats


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_great_circle(spark):
    ny, sf = (F.lit(40.730610), F.lit(-73.935242)), (F.lit(37.773972), F.lit(-122.431297))
    row = one(spark, geo.haversine(*ny, *sf).alias("h"), geo.vincenty(*ny, *sf).alias("v"), geo.vincenty(*map(F.lit, (0.0, 0.0, 0.0, 180.0))).alias("half"))
    assert abs(row.h - 4140.175) < 0.001 and abs(row.v - 4140.175) < 0.001 and abs(row.half - math.pi * 6378.137) < 1e-6


def test_tiles_and_projection(spark):
    row = one(spark, geo.tile_x(F.lit(8.57747), 14).alias("x"), geo.tile_y(F.lit(50.20731), 14).alias("y"), geo.tile_x(F.lit(13.405), 14).alias("bx"), geo.tile_y(F.lit(52.52), 14).alias("by"))
    assert (row.x, row.y, row.bx, row.by) == (8582, 5541, 8802, 5373)
    lats = spark.range(-70, 71).select((geo.lat_to_y(F.col("id").cast("double")) - geo.lat_to_y_approx(F.col("id").cast("double"))).alias("d"))
    assert max(abs(r.d) for r in lats.collect()) < 1e-11


def test_bits(spark):
    row = one(spark, bits.choose(F.lit(64), F.lit(32)).cast("string").alias("c"), bits.prev_power_of_two(F.lit(0).cast("long")).alias("z"), bits.prev_power_of_two(F.lit(17).cast("long")).alias("p"), bits.zigzag(F.lit(-2147483648)).alias("m"), bits.set_bits(F.lit(10).cast("long")).alias("b"), bits.lowest_set_bit(F.lit(0).cast("long")).alias("none"))
    assert (row.c, row.z, row.p, row.m, row.b, row.none) == ("1832624140942590534", 0, 16, 4294967295, [3, 1], None)


def test_encoders(spark):
    line = one(spark, encoders.geometry(F.array(F.lit(2), F.lit(2), F.lit(10)), F.array(F.lit(2), F.lit(10), F.lit(10))).alias("a"), encoders.geometry(F.array(F.lit(3), F.lit(8), F.lit(20)), F.array(F.lit(6), F.lit(12), F.lit(34)), True).alias("b"))
    assert line.a == [9, 4, 4, 18, 0, 16, 16, 0] and line.b == [9, 6, 12, 18, 10, 12, 24, 44, 15]
    assert encoders.polyline_text([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert encoders.polyline_points("_p~iF~ps|U_ulLnnqC_mqNvxq`@") == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


# Fixed values of the graphs in FIXTURES.md: (src, dst, capacity or weight).
FLOW_A = [(0, 1, 16), (0, 2, 13), (1, 2, 10), (1, 3, 12), (2, 1, 4), (2, 4, 14), (3, 2, 9), (3, 5, 20), (4, 3, 7), (4, 5, 4)]
FLOW_B = [(0, 1, 5), (0, 4, 7), (0, 5, 6), (1, 2, 4), (1, 7, 3), (4, 7, 4), (4, 6, 1), (5, 6, 5), (2, 3, 3), (7, 3, 7), (6, 7, 1), (6, 3, 6)]


def test_max_flow():
    assert flow.max_flow(FLOW_A, 0, 5) == (23, {0, 1, 2, 4})
    assert flow.max_flow(FLOW_B, 0, 3) == (15, {0, 4, 5})
    assert flow.max_flow(FLOW_A, 0, 5, bound=5) is None


def test_max_flow_against_augmenting_paths():
    """Random graphs against plain augmentation."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(4, 9))
        arcs = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, n, 25), rng.integers(0, n, 25), rng.integers(1, 9, 25), strict=True)]
        cap = np.zeros((n, n), int)
        for a, b, c in arcs:
            cap[a, b] += c * (a != b)
        total = 0
        while True:
            parent, stack = {0: None}, [0]
            while stack:
                u = stack.pop()
                for v in np.flatnonzero(cap[u] > 0).tolist():
                    if v not in parent:
                        parent[v] = u
                        stack.append(v)
            if n - 1 not in parent:
                break
            path, v = [], n - 1
            while parent[v] is not None:
                path.append((parent[v], v))
                v = parent[v]
            push = min(cap[a, b] for a, b in path)
            for a, b in path:
                cap[a, b] -= push
                cap[b, a] += push
            total += push
        assert flow.max_flow(arcs, 0, n - 1)[0] == total


def test_spanning_forest(spark):
    arcs = [(0, 1, 7), (0, 3, 5), (1, 3, 9), (1, 2, 8), (1, 4, 7), (2, 4, 5), (3, 4, 15), (3, 5, 6), (5, 4, 8), (6, 4, 9), (5, 6, 11)]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(arcs)], "edge_id long, src long, dst long, w long")
    got = frontier.spanning_forest(df).collect()
    assert sum(r.w for r in got) == 39 and len(got) == 6


def test_strong_components(spark):
    arcs = [(0, 1), (1, 2), (1, 4), (1, 5), (2, 3), (2, 6), (3, 2), (3, 7), (4, 0), (4, 5), (5, 6), (6, 5), (7, 3), (7, 6)]
    df = spark.createDataFrame(arcs, "src long, dst long")
    got = {r.node: r.component for r in frontier.strong_components(df, spark.range(8).withColumnRenamed("id", "node")).collect()}
    assert got == {0: 0, 1: 0, 4: 0, 2: 2, 3: 2, 7: 2, 5: 5, 6: 5}
    assert not frontier.cyclic_core(df).isEmpty()
    assert frontier.cyclic_core(spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, dst long")).isEmpty()


def test_two_cells(spark):
    arcs = [(0, 1, 3), (1, 2, 7), (2, 3, 5)]
    e = spark.createDataFrame(arcs + [(b, a, w) for a, b, w in arcs], "src long, dst long, w long")
    cells = spark.createDataFrame([(n, 0, n // 2) for n in range(4)] + [(n, 1, 0) for n in range(4)], "node long, level int, cell long")
    pairs = spark.createDataFrame([(0, t) for t in (1, 2, 3)], "source long, target long")
    for both in (False, True):
        assert sorted(r.distance for r in hierarchy.overlay_distances(e, cells, pairs, both_ends=both).collect()) == [3, 10, 15]
    tables = hierarchy.cell_distances(e, cells)
    wrong = tables.withColumn("w", F.col("w") + F.when((F.col("u") == 1) & (F.col("v") == 1), 1).otherwise(0))
    assert hierarchy.cell_mismatches(e, cells, tables).count() == 0 and hierarchy.cell_mismatches(e, cells, wrong).count() == 1


def test_overlay_on_one_way_grids(spark):
    from roadloom.sources.derived import grid_cells, grid_edges

    e = grid_edges(spark, 8, one_way=True)
    pairs = spark.range(64).selectExpr("id AS source", "(id * 29 + 3) % 64 AS target")
    want = {(r.source, r.target): r.distance for r in batched.pair_distances(e, pairs).collect()}
    for both in (False, True):
        got = {(r.source, r.target): r.distance for r in hierarchy.overlay_distances(e, grid_cells(spark, 8), pairs, both_ends=both).collect()}
        assert got == want


def test_unreachable_and_missing_nodes(spark):
    e = spark.createDataFrame([(0, 1, 2)], "src long, dst long, w long")
    pairs = spark.createDataFrame([(1, 0), (0, 1), (5, 5), (5, 0)], "source long, target long")
    got = {(r.source, r.target): r.distance for r in batched.pair_distances(e, pairs, "bidirectional").collect()}
    assert got == {(1, 0): None, (0, 1): 2, (5, 5): 0, (5, 0): None}
    assert frontier.path_to(frontier.bfs_levels(e, spark.range(1).withColumnRenamed("id", "node")), 1).orderBy("pos").collect()[0].node == 0


def test_inertial_cut():
    """Two triangles joined by one arc each way."""
    arcs = [(a, b) for part in ((0, 1, 2), (3, 4, 5)) for a in part for b in part if a != b] + [(2, 3), (3, 2)]
    nodes = [(0, 0, 0), (1, 1, 0), (2, 2, 1), (3, 5, 1), (4, 6, 0), (5, 7, 0)]
    axis, cut, balance, left, right = flow.best_cut(nodes, arcs, 0.25)
    assert (cut, balance, sorted([left, right])) == (1, 0.5, [[0, 1, 2], [3, 4, 5]])
    assert flow.inertial_cut(nodes, [], 0, 0.25) is None
    for outside in (0, 0.5):
        with pytest.raises(ValueError, match="balance"):
            flow.inertial_cut(nodes, arcs, 0, outside)


@pytest.mark.parametrize("kind", ["even", "clusters", "line", "lattice"])
def test_star_triangulation(kind):
    """Stars and the sweep give the same triangles. In dense clusters far apart and along lines, where the sweep's circles
    are too coarse, and on a lattice, where circles tie, there are as many as there must be and they cover the hull."""
    from roadloom.operators.delaunay import triangles

    rng = np.random.default_rng(5)
    points = {
        "even": rng.random((1500, 2)),
        "clusters": np.vstack([rng.random((40, 2)) * 100] + [rng.normal(c, 0.01, (300, 2)) for c in rng.random((5, 2)) * 100]),
        "line": np.column_stack([rng.random(800) * 1000, rng.random(800)]),
        "lattice": np.stack(np.meshgrid(np.arange(25.0), np.arange(25.0)), -1).reshape(-1, 2),
    }[kind]
    turned = lambda t: {tuple(np.roll(r, -int(np.argmin(r))).tolist()) for r in np.asarray(t)}
    got = triangles(points, spatial.sweep)
    if kind != "even":
        a, b, c = (points[got[:, k]] for k in range(3))
        area = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
        rim = np.array([(x, y) for y, x in spatial.hull([(int(y * 2**40), int(x * 2**40)) for x, y in points.tolist()])], float) / 2**40
        x, y = rim.T
        whole = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
        border = 96 if kind == "lattice" else len(rim)
        assert len(got) == 2 * len(points) - 2 - border and (area > 0).all() and abs(area.sum() - whole) < 1e-6 * whole
    else:
        assert turned(got) == turned(spatial.sweep(points))


def test_hull_and_triangles():
    grid = [(i, j) for i in range(10) for j in range(10)]
    assert spatial.hull(grid) == [(0, 0), (0, 9), (9, 9), (9, 0)]
    rng = np.random.default_rng(1)
    points = rng.random((60, 2))
    triangles = spatial.triangulate(points)
    corners = len(spatial.hull([(int(y * 1e6), int(x * 1e6)) for x, y in points]))
    assert len(triangles) == 2 * 60 - 2 - corners
    for a, b, c in triangles:  # no point inside a circumcircle
        (ax, ay), (bx, by), (cx, cy) = points[[a, b, c]]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        assert (((points - [ux, uy]) ** 2).sum(1) > (ax - ux) ** 2 + (ay - uy) ** 2 - 1e-9).all()
    assert spatial.triangulate(np.array([[0.0, 0], [1, 1], [2, 2]])) == []
    assert len(spatial.rings(spatial.alpha_edges(points, 10.0))) == 1


def test_small_operators(spark):
    assert sorted(coding.huffman_lengths([5, 9, 12, 13, 16, 45])) == [1, 3, 3, 3, 4, 4] and coding.huffman_lengths([7]) == [1]
    items = spark.createDataFrame([(0, i, s) for i, s in enumerate((2, 5, 4, 7, 1, 3, 8))], "g long, i long, s long")
    assert [r.bin for r in relational.next_fit(items, "g", "i", "s", 11).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert [r.bin for r in relational.next_fit(items, "g", "i", "s", 10).orderBy("i").collect()] == [0, 0, 1, 2, 2, 3, 4]
    with pytest.raises(ValueError):
        relational.next_fit(items, "g", "i", "s", 0)
    assert [coding.weighted_word(2, i) for i in range(4)] == [3, 5, 6, 9] and coding.weighted_word(64, 0) == 2**64 - 1
    assert sketches.bloom_size(1000, 0.01) == (9585, 6)
    w = tours._matrix(spark.createDataFrame([(i, j, abs(i - j)) for i in range(5) for j in range(5)], "i long, j long, w long").toPandas())
    assert tours.brute_force(w)[0] == 8 and tours.nearest_neighbour(w)[0] == 8 and tours.prim(w)[0] == 4 and tours.prim(w, []) == (0, [])
    runs = spark.createDataFrame([(0, i, v) for i, v in enumerate((1, 1, 2, 2, 2, 3, 3, 1))], "g long, i long, v long")
    assert [(r.v, r.length) for r in relational.equal_runs(runs, "g", ["i"], "v").orderBy("run").collect()] == [(1, 2), (2, 3), (3, 2), (1, 1)]


@pytest.fixture
def write(tmp_path):
    def put(text, name="f.txt"):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return put


def arcs_of(df):
    return sorted((r.src, r.dst, r.w) for r in df.collect())


def test_readers(spark, write):
    assert arcs_of(formats.read_dimacs(spark, write("c x\np sp 4 5\na 1 2 1\na 2 3 5\na 1 1 1\na 3\na x y 1\n"))) == [(0, 1, 1), (1, 2, 5)]
    assert [tuple(r) for r in formats.read_dimacs_coordinates(spark, write("p aux sp co 1\nv 1 100 200\n")).collect()] == [(0, 200, 100)]
    assert arcs_of(formats.read_ddsg(spark, write("d\n2 1\n0 1 10 0\n"))) == [(0, 1, 10), (1, 0, 10)]
    assert arcs_of(formats.read_ddsg(spark, write("d\n3 3\n0 1 10 1\n1 2 20 2\n2 0 30 3\n", "g.txt"))) == [(0, 1, 10), (2, 1, 20)]
    assert arcs_of(formats.read_ddsg(spark, write("x\n0 1 10 0\n", "h.txt"))) == []
    assert arcs_of(formats.read_metis(spark, write("4 8\n3 2\n2 3\n1 3\n1 2\n", "m.txt"))) == [(0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 0, 1), (3, 0, 1), (3, 1, 1)]
    assert [tuple(r) for r in formats.read_metis_coordinates(spark, write("1234567 4567890\n", "c.txt")).collect()] == [(0, 12.34567, 45.6789)]
    euc = "NAME: t\nDIMENSION: 4\nEDGE_WEIGHT_TYPE: EUC_2D\nNODE_COORD_SECTION\n1 0 0\n2 3 0\n3 0 4\n4 3 4\nEOF\n"
    assert sorted(r.w for r in formats.read_tsplib(spark, write(euc, "t.tsp")).where("i = 0 AND j > 0").collect()) == [3, 4, 5]
    low = "DIMENSION: 3\nEDGE_WEIGHT_TYPE: EXPLICIT\nEDGE_WEIGHT_FORMAT: LOWER_DIAG_ROW\nEDGE_WEIGHT_SECTION\n0\n1 0\n2 3 0\nEOF\n"
    assert [r.w for r in formats.read_tsplib(spark, write(low, "l.tsp")).orderBy("i", "j").collect()] == [0, 1, 2, 1, 0, 3, 2, 3, 0]


def test_writers(spark, tmp_path):
    h = spark.createDataFrame([(7, [(0, 0), (0, 1000000), (1000000, 1000000)])], "cell long, ring array<struct<lat:int,lon:int>>")
    import json

    formats.feature_collection(formats.polygon_features(h), str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    feature = json.loads(text)["features"][0]
    assert feature["bbox"] == [0.0, 0.0, 1.0, 1.0] and feature["geometry"]["coordinates"][0][0] == feature["geometry"]["coordinates"][0][-1]
    pairs = spark.createDataFrame([(1, 2, 4, 9)], "source long, target long, rank long, distance long")
    formats.write_csv(pairs, str(tmp_path / "p"))
    assert formats.read_pairs(spark, str(tmp_path / "p")).collect() == pairs.collect()


def test_streamed_runs(spark, small, tmp_path):
    """A stream's closed runs are the batch runs but for each user's last one."""
    from collections import Counter

    from roadloom.streaming.runs import stream_runs

    events = spark.read.parquet(f"{small}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream_runs(stream).writeStream.format("memory").queryName("runs_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = Counter((r.user_id, r.event_type, r.length) for r in spark.table("runs_out").collect())
    batch = relational.equal_runs(events, "user_id", ["ts", "event_id"], "event_type").collect()
    last = {}
    for r in batch:
        last[r.user_id] = max(last.get(r.user_id, 0), r.run)
    assert got == Counter((r.user_id, r.event_type, r.length) for r in batch if r.run < last[r.user_id])
