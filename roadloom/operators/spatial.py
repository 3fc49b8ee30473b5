"""Window and nearest-neighbour queries over points, hulls and triangulations.

Points get a grid cell; windows and neighbours join on cells first and compare exactly afterwards, so no query meets
all points. Written sorted by ``zorder_key``, files prune by their statistics as well.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.boxes import SIDES, Haversine, box, center, contains, geojson_bbox, intersects, is_valid
from roadloom.functions.geo import haversine, zorder_key
from roadloom.operators.delaunay import triangles as star_triangles
from roadloom.session import saved, ship

CELL = 5_000_000  # micro-degrees
SWEEP = 64  # points from which on triangulations go star by star


def _cells(box: Column, cell: int) -> tuple[Column, Column]:
    """The rows and columns of grid cells that a box touches."""
    floor = lambda c: F.floor(box[c] / cell)
    return F.sequence(floor("min_lat"), floor("max_lat")), F.sequence(floor("min_lon"), floor("max_lon"))


def in_windows(points: DataFrame, boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """box_id, id of the points (id, lat, lon) inside each box (box_id, min_lat, min_lon, max_lat, max_lon), borders included."""
    own = boxes.select("box_id", F.struct(*SIDES).alias("box"))
    rows, columns = _cells(F.col("box"), cell)
    covered = own.withColumn("ci", F.explode(rows)).withColumn("cj", F.explode(columns))
    placed = points.select("id", "lat", "lon", F.floor(F.col("lat") / cell).alias("ci"), F.floor(F.col("lon") / cell).alias("cj"))
    return placed.join(covered, ["ci", "cj"]).where(contains(F.col("box"), F.col("lat"), F.col("lon"))).select("box_id", "id")


def intersecting(elements: DataFrame, windows: DataFrame, cell: int = CELL) -> DataFrame:
    """window_id, id of the elements (id, box) whose box meets a window (window_id, box); touching is enough, invalid boxes
    meet nothing. Both sides go to the grid cells that they touch; a pair is told in the cell that holds the south-west
    corner of its common part, so each comes once."""

    def placed(rows: DataFrame) -> DataFrame:
        i, j = _cells(F.col("box"), cell)
        return rows.where(is_valid(F.col("box"))).withColumn("ci", F.explode(i)).withColumn("cj", F.explode(j))

    a, b = placed(elements.select("id", "box")), placed(windows.select("window_id", F.col("box").alias("box"))).withColumnRenamed("box", "window")
    corner = lambda c: F.floor(F.greatest(F.col("box")[c], F.col("window")[c]) / cell)
    met = a.join(b, ["ci", "cj"]).where(intersects(F.col("box"), F.col("window")) & (F.col("ci") == corner("min_lat")) & (F.col("cj") == corner("min_lon")))
    return met.select("window_id", "id")


def write_clustered(points: DataFrame, path: str, files: int = 200) -> None:
    """Writes points (lat, lon, ...) in ranges of the Z-order curve, sorted along it: each file and row group covers a small
    box, so window filters on lat and lon skip most of them by their statistics."""
    keyed = points.withColumn("_z", zorder_key(F.col("lat"), F.col("lon")))
    keyed.repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(path)


def window_filter(points: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """The points inside one box (min_lat, min_lon, max_lat, max_lon), by a filter that reaches the scan."""
    return points.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))


def nearest(points: DataFrame, queries: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """query_id, id, distance (km), rank of the k points nearest to each query (query_id, lat, lon). Ties go to the smaller
    id; rows without coordinates meet nothing. Cells start at width `cell` and are halved while they are crowded."""
    one = F.lit(0).alias("group")
    return _nearest(points.select(one, "id", "lat", "lon"), queries.select(one, "query_id", "lat", "lon"), k, Haversine, cell)


def _nearest(points: DataFrame, queries: DataFrame, k: int, metric: type, cell: int) -> DataFrame:
    """The k points of its group nearest to each query, over cells that hold some 2 k points whatever the table's size.

    The nine cells around a query find k points; the k-th distance bounds where nearer ones can be. Where the cells do not
    cover that circle, the cells under the circle are read, once. Queries with fewer than k points in nine cells go on with
    cells of twice the width. Queries at one place are searched once, and of the points at one place only the first k
    take part. Ranks are cut to k before the rows meet."""
    sphere = issubclass(metric, Haversine)
    km_degree = math.pi / 180 * 6378.137
    there = "lat IS NOT NULL AND lon IS NOT NULL"
    first = F.row_number().over(Window.partitionBy("group", "lat", "lon").orderBy("id"))
    held = saved(points.where(there).withColumn("_n", first).where(F.col("_n") <= k).select("group", "id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")))
    left, done = saved(queries.where(there).select("group", "lat", "lon").distinct()), []
    order = Window.partitionBy("group", "lat", "lon").orderBy("distance", "id")
    if sphere:
        span = 360_000_000
    else:
        ends = held.select(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon")).union(left.select("lat", "lon")).agg(*(f(c) for c in ("lat", "lon") for f in (F.min, F.max))).first()
        cell = span = max(int(ends[1] - ends[0]), int(ends[3] - ends[2])) + 1 if ends[0] is not None else 1

    def column(j: Column, width: int) -> Column:
        return F.pmod(j, F.lit(-(-360_000_000 // width))) if sphere else j

    def placed(width: int) -> DataFrame:
        return held.withColumn("ci", F.floor(F.col("p_lat") / width)).withColumn("cj", column(F.floor(F.col("p_lon") / width), width))

    def crowd(width: int) -> float:
        """Points in the cell of a point, on average."""
        n = F.col("count").cast("double")
        return placed(width).groupBy("group", "ci", "cj").count().agg(F.sum(n * n) / F.sum(n)).first()[0] or 0.0

    def found(rows: DataFrame, low: Column, high: Column, wide: Column, width: int) -> DataFrame:
        """The k nearest points in cell rows low to high and `wide` cells to either side."""
        qj = F.floor(F.col("lon") / width)
        rows = rows.select("group", "lat", "lon", F.explode(F.sequence(low, high)).alias("ci"), F.array_distinct(F.transform(F.sequence(qj - wide, qj + wide), lambda j: column(j, width))).alias("cj"))
        near = rows.withColumn("cj", F.explode("cj")).join(placed(width), ["group", "ci", "cj"]).withColumn("distance", metric.distance(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")))
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("group", "lat", "lon", "id", "distance")

    def breadth(far: Column, width: int) -> Column:
        """Cells to either side that a circle spans; on the sphere, of so many degrees at the latitude that it reaches."""
        if not sphere:
            return F.ceil(far / width).cast("long")
        half, reach = F.lit(-(-360_000_000 // width) // 2 + 1), F.abs(F.col("lat") / 1e6) + far
        ratio = F.sin(F.radians(F.least(far, F.lit(89.0)))) / F.cos(F.radians(F.least(reach, F.lit(89.0))))
        cells = F.ceil(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1e6 / width) + 1
        return F.when((reach >= 89.0) | (ratio >= 1.0), half).otherwise(F.least(cells, half)).cast("long")

    unit, most = 1e6 if sphere else 1.0, max(8, 2 * k)
    width = cell
    while width > 1 and (now := crowd(width)) > most:
        width = max(1, width >> math.ceil(math.log(now / most, 4)))
    while True:
        qi, whole, side = F.floor(F.col("lat") / width), width >= span, F.lit(width / unit)
        full = saved(found(left, qi - 1, qi + 1, breadth(side, width), width))
        far = F.col("far") / (km_degree if sphere else 1.0)
        stat = full.groupBy("group", "lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        got = saved(left.join(stat, ["group", "lat", "lon"], "left").withColumn("sure", F.lit(whole) | (far <= side)))
        keep = got.where(F.lit(whole) | (F.col("n") == k))
        done.append(full.join(keep.where("sure").select("group", "lat", "lon"), ["group", "lat", "lon"], "left_semi"))
        wider = keep.where("NOT sure").select("group", "lat", "lon", "far")
        row = lambda v: F.floor(v * unit / width)
        done.append(found(wider, row(F.col("lat") / unit - far), row(F.col("lat") / unit + far), breadth(far, width), width))
        left = saved(got.where((F.coalesce("n", F.lit(0)) < k) & ~F.lit(whole)).select("group", "lat", "lon"))
        if whole or left.isEmpty():
            break
        width = min(2 * width, span)
    near = queries.select("group", "query_id", "lat", "lon").join(reduce(DataFrame.union, done), ["group", "lat", "lon"])
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def nearest_in(points: DataFrame, queries: DataFrame, k: int, metric: type = Haversine) -> DataFrame:
    """query_id, id, distance, rank by a metric (boxes.Haversine, boxes.Planar) for points (group, id, lat, lon) and queries
    (group, query_id, lat, lon) of the same group. Ties go to the smaller id."""
    return _nearest(points.select("group", "id", "lat", "lon"), queries.select("group", "query_id", "lat", "lon"), k, metric, CELL)


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Convex hull of (lat, lon) counter-clockwise (x = lon) from the smallest (lon, lat), collinear points dropped. Up to
    three points come back as given."""
    if len(points) <= 3:
        return list(points)
    at = sorted({(lon, lat) for lat, lon in points})
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for side in (at, at[::-1]):
        chain: list[tuple[int, int]] = []
        for p in side:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        halves.append(chain[:-1])
    return [(lat, lon) for lon, lat in halves[0] + halves[1]]


def extreme_points(points: DataFrame, key: str) -> DataFrame:
    """Points that may be on their group's hull: those not strictly inside the quadrilateral of the group's four extreme
    points. A map-side reduction for hulls of large groups."""
    lat, lon = F.col("lat").cast("long"), F.col("lon").cast("long")
    ends = points.groupBy(key).agg(*(f(F.struct("lat", "lon"), v).alias(n) for n, f, v in (("w", F.min_by, lon), ("e", F.max_by, lon), ("s", F.min_by, lat), ("n", F.max_by, lat))))
    inside = None
    for a, b in (("w", "s"), ("s", "e"), ("e", "n"), ("n", "w")):
        cross = (F.col(f"{b}.lon") - F.col(f"{a}.lon")).cast("long") * (lat - F.col(f"{a}.lat")) - (F.col(f"{b}.lat") - F.col(f"{a}.lat")).cast("long") * (lon - F.col(f"{a}.lon"))
        inside = (cross > 0) if inside is None else inside & (cross > 0)
    return points.join(ends, key).where(~inside).select(points.columns)


def hulls(points: DataFrame, key: str) -> DataFrame:
    """key, ring (array of struct(lat, lon)) of points (key, lat, lon); inner points are shed before the shuffle."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [f[key].iloc[0]], "ring": [[{"lat": a, "lon": b} for a, b in hull([*zip(f.lat.tolist(), f.lon.tolist(), strict=True)])]]})

    ship(points.sparkSession)
    return extreme_points(points.select(key, "lat", "lon"), key).groupBy(key).applyInPandas(one, f"{key} long, ring array<struct<lat:int,lon:int>>")


def hull_boxes(hulls_: DataFrame) -> DataFrame:
    """hulls (cell, ring) with bbox ([west, south, east, north] in degrees) and place: the position of a hull along the Z-order
    curve of the boxes' centres, as exports list them."""
    from roadloom.operators.relational import global_prefix_sums

    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    boxed = hulls_.withColumn("_box", box(side(F.array_min, "lat"), side(F.array_min, "lon"), side(F.array_max, "lat"), side(F.array_max, "lon")))
    key = F.struct(zorder_key(*center(F.col("_box"))).alias("z"), "cell")
    placed = global_prefix_sums(boxed.withColumn("_key", key).withColumn("_one", F.lit(1).cast("long")), "_key", "_one", 8)
    return placed.select("cell", "ring", geojson_bbox(F.col("_box")).alias("bbox"), (F.col("prefix") - 1).alias("place"))


def triangulate(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles (positions, in turning order) of distinct planar points. Collinear input has none."""
    return sweep(points) if len(points) < SWEEP else [*map(tuple, star_triangles(points, sweep).tolist())]


def sweep(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles by insertion from left to right: each point removes the triangles whose circumcircle holds it and
    joins the rim of the hole; triangles whose circle lies wholly to the left are final and leave the search. For few
    points: the open triangles are all looked at."""
    n = len(points)
    if n < 3:
        return []
    low, high = points.min(0), points.max(0)
    span = float(max(high - low)) or 1.0
    mid = (low + high) / 2
    at = np.vstack([points - mid, np.array([[-30.0, -20.0], [30.0, -20.0], [0.0, 40.0]]) * span * 1000]).tolist()

    def circle(a: int, b: int, c: int) -> tuple[float, float, float]:
        ox, oy = at[a]
        bx, by, cx, cy = at[b][0] - ox, at[b][1] - oy, at[c][0] - ox, at[c][1] - oy
        d, bb, cc = 2 * (bx * cy - by * cx), bx * bx + by * by, cx * cx + cy * cy
        if abs(d) <= 1e-14 * (bb + cc):
            return 0.0, 0.0, math.inf
        ux, uy = (bb * cy - cc * by) / d, (cc * bx - bb * cx) / d
        return ux + ox, uy + oy, ux * ux + uy * uy

    triangles, final = {(n, n + 1, n + 2): circle(n, n + 1, n + 2)}, []
    for p in np.lexsort((points[:, 1], points[:, 0])).tolist():
        x, y = at[p]
        bad, past = [], []
        for t, (ux, uy, r) in triangles.items():
            dx, reach = x - ux, r * (1 + 1e-12)
            if dx > 0 and dx * dx >= reach:
                past.append(t)
            elif dx * dx + (y - uy) * (y - uy) < reach:
                bad.append(t)
        for t in past:
            del triangles[t]
        final += past
        rim: dict[tuple[int, int], bool] = {}
        for a, b, c in bad:
            for e in ((a, b), (b, c), (c, a)):
                if e[::-1] in rim:
                    del rim[e[::-1]]
                else:
                    rim[e] = True
            del triangles[a, b, c]
        for a, b in rim:
            triangles[a, b, p] = circle(a, b, p)
    return [t for t in [*final, *triangles] if max(t) < n and circle(*t)[2] < math.inf]


def alpha_edges(points: np.ndarray, alpha: float) -> list[tuple[int, int]]:
    """Directed border edges of the triangles whose circumradius is at most alpha."""
    edges = set()
    for a, b, c in triangulate(points):
        p, q, r = points[a], points[b], points[c]
        sides = [float(np.hypot(*(u - v))) for u, v in ((p, q), (q, r), (r, p))]
        area = abs((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])) / 2
        if area and sides[0] * sides[1] * sides[2] / (4 * area) <= alpha:
            edges |= {(a, b), (b, c), (c, a)}
    return [e for e in edges if e[::-1] not in edges]


def rings(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Closed chains of directed edges."""
    after: dict[int, list[int]] = {}
    for a, b in sorted(edges):
        after.setdefault(a, []).append(b)
    out = []
    while after:
        start = at = min(after)
        ring = []
        while at in after:
            ring.append(at)
            follow = after[at].pop(0)
            if not after[at]:
                del after[at]
            at = follow
            if at == start:
                break
        out.append(ring)
    return out


def alpha_shapes(points: DataFrame, key: str, alpha: float) -> DataFrame:
    """key, ring (number), pos, x, y of the alpha shapes of points (key, x, y), one group a task."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        at = np.unique(f[["x", "y"]].to_numpy(float), axis=0)
        rows = [(f[key].iloc[0], i, j, *at[p]) for i, ring in enumerate(rings(alpha_edges(at, alpha))) for j, p in enumerate(ring)]
        return pd.DataFrame(rows, columns=[key, "ring", "pos", "x", "y"])

    ship(points.sparkSession)
    return points.select(key, "x", "y").groupBy(key).applyInPandas(one, f"{key} long, ring int, pos int, x double, y double")


def delaunay(points: DataFrame, key: str) -> DataFrame:
    """key, a, b, c: triangles over the ids of points (key, id, x, y), each from its smallest id in turning order."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id").drop_duplicates(["x", "y"])
        ids = f.id.tolist()
        rows = []
        for t in triangulate(f[["x", "y"]].to_numpy(float)):
            t = [ids[i] for i in t]
            k = t.index(min(t))
            rows.append((f[key].iloc[0], *t[k:], *t[:k]))
        return pd.DataFrame(rows, columns=[key, "a", "b", "c"])

    ship(points.sparkSession)
    return points.select(key, "id", "x", "y").groupBy(key).applyInPandas(one, f"{key} long, a long, b long, c long")
