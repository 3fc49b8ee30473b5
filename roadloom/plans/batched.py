"""Many independent searches: the queries are partitioned, and a graph that fits in a task goes out once an executor.

``local_graph`` counts before anything is collected. Graphs with more arcs take the iterated joins of ``frontier`` with
the same rows; counters of nodes settled, inserted and decreased describe a kernel's run and are null there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.plans import frontier
from roadloom.session import LOCAL_ROWS, fits, saved, ship

COUNTERS = "settled long, inserted long, decreased long"


class LocalGraph:
    """Arcs sorted by source: heads and weights of node u at bounds[u]:bounds[u + 1]; nodes are 0 to n - 1."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int | None = None):
        order = np.lexsort((w, dst, src))
        self.n = int(max(n or 0, src.max(initial=-1) + 1, dst.max(initial=-1) + 1, 1))
        self.dst, self.w = dst[order], w[order]
        self.bounds = np.searchsorted(src[order], np.arange(self.n + 1))
        self._lists = None

    def lists(self) -> list[list[tuple[int, int]]]:
        if self._lists is None:
            pairs = list(zip(self.dst.tolist(), self.w.tolist(), strict=True))
            b = self.bounds.tolist()
            self._lists = [pairs[b[u] : b[u + 1]] for u in range(self.n)]
        return self._lists

    def reversed(self) -> LocalGraph:
        src = np.repeat(np.arange(self.n), np.diff(self.bounds))
        return LocalGraph(self.dst, src, self.w, self.n)

    def __getstate__(self):
        return {"n": self.n, "dst": self.dst, "w": self.w, "bounds": self.bounds, "_lists": None}


def local_graph(edges: DataFrame, most: int | None = None) -> LocalGraph | None:
    """The arcs (src, dst, w) as arrays, if there are at most `most` (LOCAL_ROWS) of them; else None."""
    edges = edges.select("src", "dst", "w")
    if not fits(edges, LOCAL_ROWS if most is None else most):
        return None
    got = edges.toPandas()
    return LocalGraph(*(got[c].to_numpy(np.int64) for c in ("src", "dst", "w")))


@dataclass
class Counters:
    """What a search did to its queue: nodes taken off for good, put on, and moved forward."""

    settled: int = 0
    inserted: int = 0
    decreased: int = 0

    def row(self) -> tuple[int, int, int]:
        return self.settled, self.inserted, self.decreased


def settle(graph: LocalGraph, source: int, targets: set[int] | None = None, count: Counters | None = None) -> Iterator[tuple[int, int, int]]:
    """(node, distance, parent) in settling order: by distance, then node; parents are the smallest possible. Ends when
    all targets are settled."""
    arcs, best, open_targets = graph.lists(), {source: (0, -1)}, set(targets) if targets is not None else None
    heap, done, count = [(0, source)], set(), count or Counters()
    count.inserted += 1
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        count.settled += 1
        yield u, d, best[u][1]
        if open_targets is not None:
            open_targets.discard(u)
            if not open_targets:
                return
        for v, w in arcs[u] if u < graph.n else ():
            known = best.get(v)
            if known is None or (d + w, u) < known and v not in done:
                best[v] = d + w, u
                if known is None or d + w < known[0]:
                    count.inserted += known is None
                    count.decreased += known is not None
                    heapq.heappush(heap, (d + w, v))


def _integers(values: list) -> pd.array:
    return pd.array(values, "Int64")


def one_to_all(edges: DataFrame, sources: DataFrame, parents: bool = True) -> DataFrame:
    """source, node, dist, parent (null at the source) of every node reached from each source (column node). Without
    parents, joins leave out the column that they would spend another pass on."""
    graph = local_graph(edges)
    if graph is None:
        return frontier.all_distances(edges, sources) if parents else frontier.relaxed(edges, sources)
    held = edges.sparkSession.sparkContext.broadcast(graph)

    def run(frames):
        for f in frames:
            for s in f["node"].tolist():
                got = [*settle(held.value, s)]
                yield pd.DataFrame({"source": s, "node": [g[0] for g in got], "dist": [g[1] for g in got], "parent": _integers([None if g[2] < 0 else g[2] for g in got])})

    ship(edges.sparkSession)
    return sources.select("node").mapInPandas(run, "source long, node long, dist long, parent long")


def _unwound(parent: dict[int, int], at: int) -> list[int] | None:
    """The nodes from the search's source to a node; None if it was not reached."""
    if at not in parent:
        return None
    path = []
    while at >= 0:
        path.append(at)
        at = parent[at]
    return path[::-1]


def one_to_many(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, target, distance, path (nodes), all_reached for rows of wanted (source, targets: an array): one search a
    source, which ends when its distinct targets are settled. Targets that can't be reached have null distance and path,
    and their source's rows say that not all were reached."""
    graph = local_graph(edges)
    if graph is None:
        pairs = wanted.select("source", F.explode(F.array_distinct("targets")).alias("target"))
        return shortest_paths(edges, pairs).withColumn("all_reached", F.min(F.col("distance").isNotNull()).over(Window.partitionBy("source")))
    held = edges.sparkSession.sparkContext.broadcast(graph)

    def run(frames):
        for f in frames:
            rows = []
            for s, targets in zip(f.source.tolist(), f.targets.tolist(), strict=True):
                targets = dict.fromkeys(map(int, targets))
                got = {u: (d, p) for u, d, p in settle(held.value, s, set(targets))} if targets else {}
                parent = {u: p for u, (_, p) in got.items()}
                rows += [(s, t, got[t][0] if t in got else None, _unwound(parent, t), all(x in got for x in targets)) for t in targets]
            yield pd.DataFrame({"source": [r[0] for r in rows], "target": [r[1] for r in rows], "distance": _integers([r[2] for r in rows]), "path": [r[3] for r in rows], "all_reached": [r[4] for r in rows]})

    ship(edges.sparkSession)
    return wanted.select("source", "targets").mapInPandas(run, "source long, target long, distance long, path array<long>, all_reached boolean")


def bidirectional(forward: LocalGraph, backward: LocalGraph, s: int, t: int, count: Counters | None = None) -> tuple[int | None, int | None, list[int] | None]:
    """(distance, meeting node, path) by two searches that stop when their heads together pass the best meeting."""
    if s == t:
        return 0, s, [s]
    count = count or Counters()
    dist, parent, done, heaps = ({s: 0}, {t: 0}), ({s: -1}, {t: -1}), (set(), set()), ([(0, s)], [(0, t)])
    best, meet = None, None
    count.inserted += 2
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] >= best:
            break
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        d, u = heapq.heappop(heaps[side])
        if u in done[side]:
            continue
        done[side].add(u)
        count.settled += 1
        graph = (forward, backward)[side]
        for v, w in graph.lists()[u] if u < graph.n else ():
            known = dist[side].get(v)
            if known is None or d + w < known:
                count.inserted += known is None
                count.decreased += known is not None
                dist[side][v], parent[side][v] = d + w, u
                heapq.heappush(heaps[side], (d + w, v))
                if v in dist[1 - side] and (best is None or (d + w + dist[1 - side][v], v) < (best, meet)):
                    best, meet = d + w + dist[1 - side][v], v
    if meet is None:
        return None, None, None
    return best, meet, _unwound(parent[0], meet) + _unwound(parent[1], meet)[-2::-1]


def pair_distances(edges: DataFrame, pairs: DataFrame, engine: str = "dijkstra") -> DataFrame:
    """source, target, distance (null: unreachable), meeting (the node where two searches met; null for engine dijkstra),
    settled, inserted, decreased for pairs (source, target)."""
    if engine not in ("dijkstra", "bidirectional"):
        raise ValueError(f"unknown engine {engine}")
    graph = local_graph(edges)
    if graph is None:
        far = frontier.all_distances(edges, pairs.select(F.col("source").alias("node")).distinct())
        rows = pairs.join(far.select("source", F.col("node").alias("target"), F.col("dist").alias("distance")), ["source", "target"], "left")
        return rows.select("source", "target", "distance", *(F.lit(None).cast("long").alias(c) for c in ("meeting", "settled", "inserted", "decreased")))
    held = edges.sparkSession.sparkContext.broadcast((graph, graph.reversed() if engine == "bidirectional" else None))

    def search(s: int, t: int) -> tuple:
        ahead, back = held.value
        count, found, meet = Counters(), None, None
        if back is not None:
            found, meet, _ = bidirectional(ahead, back, s, t, count)
        else:
            found = next((d for u, d, _ in settle(ahead, s, {t}, count) if u == t), None)
        return s, t, found, meet, *count.row()

    def run(frames):
        for f in frames:
            rows = [search(s, t) for s, t in zip(f["source"].tolist(), f["target"].tolist(), strict=True)]
            yield pd.DataFrame({c: _integers([r[i] for r in rows]) for i, c in enumerate(("source", "target", "distance", "meeting", "settled", "inserted", "decreased"))})

    ship(edges.sparkSession)
    return pairs.select("source", "target").mapInPandas(run, f"source long, target long, distance long, meeting long, {COUNTERS}")


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, target, distance, path (nodes in order) of pairs (source, target); null where unreachable."""
    graph = local_graph(edges)
    if graph is None:
        return frontier.joined_paths(frontier.all_distances(edges, pairs.select(F.col("source").alias("node")).distinct()), pairs)
    held = edges.sparkSession.sparkContext.broadcast(graph)

    def run(frames):
        for f in frames:
            rows = []
            for s, t in zip(f["source"].tolist(), f["target"].tolist(), strict=True):
                got = {u: (d, p) for u, d, p in settle(held.value, s, {t})}
                rows.append((s, t, got[t][0] if t in got else None, _unwound({u: p for u, (_, p) in got.items()}, t)))
            yield pd.DataFrame({"source": [r[0] for r in rows], "target": [r[1] for r in rows], "distance": _integers([r[2] for r in rows]), "path": [r[3] for r in rows]})

    ship(edges.sparkSession)
    return pairs.select("source", "target").mapInPandas(run, "source long, target long, distance long, path array<long>")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, pos, edge_id, src, dst, w: the arcs along paths (source, target, path), of parallel arcs the lightest
    and then the first; edges: edge_id, src, dst, w."""
    hops = paths.where("size(path) > 1").select("source", "target", F.posexplode(F.expr("zip_with(slice(path, 1, size(path) - 1), slice(path, 2, size(path) - 1), (a, b) -> struct(a AS src, b AS dst))")).alias("pos", "hop"))
    best = edges.groupBy("src", "dst").agg(F.min(F.struct("w", "edge_id")).alias("e"))
    return hops.select("source", "target", F.col("pos").cast("long").alias("pos"), "hop.src", "hop.dst").join(best, ["src", "dst"]).select("source", "target", "pos", "e.edge_id", "src", "dst", "e.w")


def rank_samples(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, target, rank, distance: for each source the nodes at ranks 1, 2, 4, 8, ... of its settling order."""
    graph = local_graph(edges)
    if graph is None:
        order = Window.partitionBy("source").orderBy("dist", "node")
        ranked = frontier.all_distances(edges, sources).withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where("rank > 0 AND rank & (rank - 1) = 0")
        return ranked.select("source", F.col("node").alias("target"), "rank", F.col("dist").alias("distance"))
    held = edges.sparkSession.sparkContext.broadcast(graph)

    def run(frames):
        for f in frames:
            out = []
            for s in f["node"].tolist():
                out += [(s, u, k, d) for k, (u, d, _) in enumerate(settle(held.value, s)) if k and k & (k - 1) == 0]
            yield pd.DataFrame(out, columns=["source", "target", "rank", "distance"]).astype("int64")

    ship(edges.sparkSession)
    return sources.select("node").mapInPandas(run, "source long, target long, rank long, distance long")


def timed_pairs(edges: DataFrame, pairs: DataFrame, engine: str = "dijkstra", seed: int = 0) -> DataFrame:
    """engine, source, target, rank, nanos, distance: pairs (source, target, rank), each search timed by itself in a
    shuffled order, one after the other in its task. The graph has to fit in a task, or there is nothing to time."""
    import time

    graph = local_graph(edges)
    if graph is None:
        raise ValueError("only searches of a kernel are timed; the graph does not fit in a task")
    held = edges.sparkSession.sparkContext.broadcast((graph, graph.reversed() if engine == "bidirectional" else None))

    def run(frames):
        for f in frames:
            rows, (ahead, back) = [], held.value
            ahead.lists()
            for s, t, k in zip(f["source"].tolist(), f["target"].tolist(), f["rank"].tolist(), strict=True):
                began = time.perf_counter_ns()
                found = bidirectional(ahead, back, s, t)[0] if back else next((d for u, d, _ in settle(ahead, s, {t}) if u == t), None)
                rows.append((s, t, k, time.perf_counter_ns() - began, found))
            yield pd.DataFrame({c: _integers([r[i] for r in rows]) for i, c in enumerate(("source", "target", "rank", "nanos", "distance"))}).assign(engine=engine)[["engine", "source", "target", "rank", "nanos", "distance"]]

    ship(edges.sparkSession)
    mixed = saved(pairs.select("source", "target", "rank").orderBy(F.xxhash64("source", "target", F.lit(seed))))
    return mixed.mapInPandas(run, "engine string, source long, target long, rank long, nanos long, distance long")
