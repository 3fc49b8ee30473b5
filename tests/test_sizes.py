"""What larger tables brought up: results at exact borders, and the size of steps that must not grow with the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import geo


def test_points_on_tile_coordinates(spark):
    """Longitudes that lie exactly on a coordinate of their tile get it, not the one before."""
    want = {375000: (130.875, 273), 750000: (81.75, 546), 93750: (-12.28125, 1092), 812500: (-46.4375, 4004), 218750: (91.34375, 3913)}
    rows = spark.createDataFrame([(k, 45.5, lon) for k, (lon, _) in want.items()], "id long, lat double, lon double")
    lat, lon = F.col("lat"), F.col("lon")
    x, _ = geo.in_tile(lat, lon, 8, geo.tile_x(lon, 8), geo.tile_y(lat, 8))
    assert {r.id: r.x for r in rows.select("id", x.alias("x")).collect()} == {k: x for k, (_, x) in want.items()}


def _brute(points, queries, k, distance):
    """query_id to the ids of its k nearest points of the same group, ties to the smaller id."""
    return {q: [i for _, i in sorted((distance(lat, lon, a, b), i) for h, i, a, b in points if h == g and a is not None)[:k]] for g, q, lat, lon in queries}


def _ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_neighbours_meet_few_points(spark):
    """Pairs that are looked at grow with the queries, not with queries times points, also where points crowd."""
    import random

    from pyspark.sql.types import DoubleType

    from roadloom.functions.boxes import Planar
    from roadloom.operators.spatial import nearest_in

    seen, rng = spark.sparkContext.accumulator(0), random.Random(1)

    class Counted(Planar):
        @staticmethod
        def distance(a, b, c, d):
            def far(a, b, c, d):
                seen.add(1)
                return ((a - c) ** 2 + (b - d) ** 2) ** 0.5

            return F.udf(far, DoubleType())(a, b, c, d)

    at = lambda n: [(0, i, *(rng.sample(range(1000), 2) if i % 2 else rng.sample(range(10**8), 2))) for i in range(n)]
    points, queries = at(1200), at(400)
    got = nearest_in(spark.createDataFrame(points, "group long, id long, lat long, lon long"), spark.createDataFrame(queries, "group long, query_id long, lat long, lon long"), 3, Counted).collect()
    assert _ranked(got) == _brute(points, queries, 3, lambda a, b, c, d: (a - c) ** 2 + (b - d) ** 2)
    assert seen.value < 1200 * 400 / 4


def test_neighbours_over_the_globe(spark):
    """Against all pairs: poles, the seam, places shared by points or by queries, rows without coordinates, few points."""
    import random
    from math import asin, cos, radians, sin, sqrt

    from roadloom.operators.spatial import nearest, nearest_in

    def km(a, b, c, d):
        a, b, c, d = (radians(x / 1e6) for x in (a, b, c, d))
        return round(2 * asin(min(1.0, sqrt(sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2))), 12)

    rng = random.Random(2)
    place = lambda: (rng.choice([rng.randint(-90, 90), 89, -90]) * 1_000_000, rng.choice([rng.randint(-180, 180), 179, -180]) * 1_000_000 + rng.randint(-9, 9) * 100_000)
    points = [(i % 2, i, *place()) for i in range(250)] + [(0, 300 + i, 1_000_000, 2_000_000) for i in range(40)] + [(0, 400, None, 5)]
    queries = [(i % 2, i, *place()) for i in range(60)] + [(0, 90 + i, 1_000_001, 2_000_001) for i in range(3)] + [(2, 99, 0, 0)]
    p, q = spark.createDataFrame(points, "group long, id long, lat int, lon int"), spark.createDataFrame(queries, "group long, query_id long, lat int, lon int")
    where = {r[1]: r[2:] for r in points}

    def check(rows, points, queries, k):
        """Distances as of all pairs; ids at (nearly) one distance may swap."""
        at = {r[1]: r[2:] for r in queries}
        of = lambda ids: {n: [round(km(*at[n], *where[i]), 9) for i in own] for n, own in ids.items() if own}
        assert of(_ranked(rows)) == of(_brute(points, queries, k, km))

    check(nearest_in(p, q, 4).collect(), points, queries, 4)
    check(nearest(p.where("group = 0"), q.where("group = 0"), 7).collect(), [r for r in points if r[0] == 0], [r for r in queries if r[0] == 0], 7)
    assert nearest(p.where("id < 2"), q, 5).count() == 2 * len(queries)


def test_text_graphs_lie_in_many_files(spark, small, monkeypatch):
    """No task writes a graph's whole text: DDSG keeps its header and METIS its line numbers over several files."""
    from roadloom.queries import QUERIES, files

    paths = []
    for name in ("read_ddsg", "read_metis", "read_dimacs"):
        monkeypatch.setattr(files.formats, name, lambda spark, path, read=getattr(files.formats, name): paths.append(path) or read(spark, path))
    for name in ("ddsg_graph", "metis_graph", "dimacs_graph"):
        assert QUERIES[name](spark, small).count() > 1000
        assert len(spark.read.text(paths[-1]).inputFiles()) > 4


def test_searches_read_the_line_items_once(spark, small):
    """Rounds join saved arcs, not the tables that the arcs come from."""
    from roadloom.queries import QUERIES

    for name in ("bfs_levels", "filtered_reach", "sssp_relational", "components", "heavy_components", "integrity"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan, name


def test_cyclic_core(spark):
    """Two cycles, a way between them that no cycle holds but that lies inside the core, and ends that go."""
    from roadloom.plans.frontier import cyclic_core

    arcs = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (6, 1), (7, 6), (5, 8), (8, 9), (10, 10), (11, 12)]
    left = cyclic_core(spark.createDataFrame(arcs, "src long, dst long"))
    assert {(r.src, r.dst) for r in left.collect()} == {(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (10, 10)}
    assert cyclic_core(left.where("src < dst")).isEmpty()


def test_components_with_loops_and_single_nodes(spark):
    from roadloom.plans.frontier import weak_components

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (7, 7), (9, 8)], "src long, dst long")
    rows = weak_components(edges, spark.createDataFrame([(3,), (20,)], "node long")).collect()
    assert sorted((r.node, r.component) for r in rows) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 8), (20, 20)]


def test_integrity_of_odd_arcs(spark):
    """Loops, doubled arcs and null ends, in parts or not."""
    from roadloom.operators.relational import integrity_violations

    edges = spark.createDataFrame([(1, 2, 5), (1, 9, 5), (9, 9, 5), (9, 9, 6), (2, 1, None), (None, 1, 1)], "src long, dst long, w long")
    nodes = spark.createDataFrame([(1,), (2,), (2,)], "node long")
    want = [("no weight", 2, 1), ("unknown node", 1, 9), ("unknown node", 9, 9), ("unknown node", None, 1)]
    for parts in (None, 3):
        assert sorted(map(tuple, integrity_violations(edges, nodes, parts).collect()), key=str) == sorted(want, key=str)
