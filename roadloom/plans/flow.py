"""Maximum flow, minimum cuts and inertial-flow bisection, one task an instance."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.session import saved, ship


def max_flow(arcs: list[tuple[int, int, int]], s: int, t: int, bound: int | None = None) -> tuple[int, set[int]] | None:
    """(flow, source side of the minimum cut) by blocking flows in layered graphs; None once the flow passes the bound."""
    cap: dict[int, dict[int, int]] = {s: {}, t: {}}
    for u, v, c in arcs:
        if u != v:
            cap.setdefault(u, {})[v] = cap.setdefault(u, {}).get(v, 0) + c
            cap.setdefault(v, {}).setdefault(u, 0)
    flow = 0
    while True:
        layer, queue = {t: 0}, deque([t])
        while queue:
            v = queue.popleft()
            for u in cap[v]:
                if u not in layer and cap[u][v] > 0:
                    layer[u] = layer[v] + 1
                    queue.append(u)
        if s not in layer:
            break
        ahead = {u: iter([*cap[u]]) for u in layer}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                push = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    cap[a][b] -= push
                    cap[b][a] += push
                flow += push
                if bound is not None and flow > bound:
                    return None
                full = next(i for i, (a, b) in enumerate(zip(path, path[1:], strict=False)) if cap[a][b] == 0)
                path = path[: full + 1]
                continue
            for v in ahead[u]:
                if cap[u][v] > 0 and layer.get(v, -1) == layer[u] - 1:
                    path.append(v)
                    break
            else:
                path.pop()
                layer[u] = -2
    side, queue = {s}, deque([s])
    while queue:
        u = queue.popleft()
        for v, c in cap[u].items():
            if c > 0 and v not in side:
                side.add(v)
                queue.append(v)
    return flow, side


def max_flows(arcs: DataFrame) -> DataFrame:
    """instance, flow, source_side for arcs (instance, src, dst, cap, s, t); parallel arcs are summed before the task."""

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        flow, side = max_flow([*zip(f.src.tolist(), f.dst.tolist(), f.cap.tolist(), strict=True)], int(f.s[0]), int(f.t[0]))
        return pd.DataFrame({"instance": [f.instance[0]], "flow": [flow], "source_side": [sorted(side)]})

    ship(arcs.sparkSession)
    merged = arcs.groupBy("instance", "src", "dst", "s", "t").agg(F.sum("cap").alias("cap"))
    return merged.groupBy("instance").applyInPandas(solve, "instance long, flow long, source_side array<long>")


#: Projections of (lat, lon): along each axis, and along the diagonals.
AXES = (lambda lat, lon: lat, lambda lat, lon: lon, lambda lat, lon: lat + lon, lambda lat, lon: lat - lon)


def valid_balance(balance: float) -> None:
    if not 0 < balance < 0.5:
        raise ValueError(f"balance {balance} is not inside (0, 0.5)")


def valid_depth(depth: int) -> None:
    if not 1 <= depth <= 31:
        raise ValueError(f"depth {depth} is not in 1 to 31")


def better_cut(a: tuple, b: tuple) -> bool:
    """Whether a cut (flow, balance, ...) comes before another: less flow, then more balance."""
    return (a[0], -a[1]) < (b[0], -b[1])


def inertial_cut(nodes: list[tuple[int, int, int]], arcs: list[tuple[int, int]], axis: int, balance: float, bound: int | None = None):
    """(flow, balance, left ids, right ids) of the cut along one axis, or None where there is none. nodes: (id, lat, lon).

    The first and last max(1, n * balance) nodes along the projection become source and target; every arc has capacity
    one. Nodes without arcs join the smaller side."""
    valid_balance(balance)
    if not arcs:
        return None
    order = [i for _, i in sorted((AXES[axis](lat, lon), i) for i, lat, lon in nodes)]
    ends = max(1, int(len(order) * balance))
    role = {i: -1 for i in order[:ends]} | {i: -2 for i in order[len(order) - ends :]}
    touched = {i for arc in arcs for i in arc} | set(role)
    found = max_flow([(role.get(u, u), role.get(v, v), 1) for u, v in arcs], -1, -2, bound)
    if found is None:
        return None
    flow, side = found
    left = [i for i in order if i in touched and role.get(i, i) in side]
    right = [i for i in order if i in touched and role.get(i, i) not in side]
    (left if len(left) <= len(right) else right).extend(i for i in order if i not in touched)
    return flow, min(len(left), len(right)) / len(order), sorted(left), sorted(right)


def best_cut(nodes: list[tuple[int, int, int]], arcs: list[tuple[int, int]], balance: float):
    """(axis, flow, balance, left, right) of the best of the four axes: least flow (at most the number of nodes), then
    greatest balance, then lowest axis."""
    cuts = [(a, c) for a in range(4) if (c := inertial_cut(nodes, arcs, a, balance, len(nodes)))]
    if not cuts:
        return None
    axis, cut = min(cuts, key=lambda x: (x[1][0], -x[1][1], x[0]))
    return axis, *cut


def bisection(edges: DataFrame, nodes: DataFrame, depth: int, balance: float = 0.25, least: int = 50) -> DataFrame:
    """node, partition_id by recursive bisection: level by level, one task a cell, arcs cut on the way dropped.

    edges: src, dst; nodes: id, lat, lon. A cell of `least` nodes or fewer, or without a cut, stays. The root is
    partition 1, the parts of p are 2p (left) and 2p + 1."""

    def split(f: pd.DataFrame) -> pd.DataFrame:
        own = f[f.kind == 0]
        ids, cell = own.a.tolist(), int(f.partition_id.iloc[0])
        arcs = [*zip(f.a[f.kind == 1].tolist(), f.b[f.kind == 1].tolist(), strict=True)]
        cut = best_cut([*zip(ids, own.lat.tolist(), own.lon.tolist(), strict=True)], arcs, balance) if len(ids) > max(least, 2) else None
        left = set(cut[3]) if cut and cut[3] and cut[4] else None
        return pd.DataFrame({"node": ids, "partition_id": [cell if left is None else 2 * cell + (i not in left) for i in ids]})

    valid_balance(balance)
    valid_depth(depth)
    ship(edges.sparkSession)
    part = saved(nodes.select(F.col("id").alias("node"), F.lit(1).cast("long").alias("partition_id")))
    left = edges.select("src", "dst")
    for _ in range(depth):
        a, b = (part.select(F.col("node").alias(k), F.col("partition_id").alias(f"p_{k}")) for k in ("src", "dst"))
        left = saved(left.join(a, "src").join(b, "dst").where("p_src = p_dst").select("src", "dst"))
        inner = left.join(a, "src").selectExpr("p_src AS partition_id", "1 AS kind", "src AS a", "dst AS b", "0 AS lat", "0 AS lon")
        rows = part.join(nodes, part.node == nodes.id).selectExpr("partition_id", "0 AS kind", "node AS a", "0L AS b", "lat", "lon").union(inner)
        new = saved(rows.groupBy("partition_id").applyInPandas(split, "node long, partition_id long"))
        if new.exceptAll(part).isEmpty():
            break
        part = new
    return part
