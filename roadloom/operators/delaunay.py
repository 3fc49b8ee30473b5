"""Delaunay triangulation of planar points, vectorised over points.

Every point gets its star, the triangles around it, from the points of a window of grid cells: from its nearest
neighbour the next neighbour in turning order is the one whose circle through both comes first, until the star closes.
A star is final if all its circles lie inside the window, since no other point can be in them. The rest try larger
windows; the few points that are left (at the hull and in sparse regions) are triangulated by a sweep among themselves,
and those of its triangles are taken whose circle holds no point at all. Points on one circle are kept apart by a tiny
fixed weight of each point, so all stars choose the same diagonals.
"""

from __future__ import annotations

import numpy as np

#: Cells on either side of a point's own in a window, points in a cell on average, and rounds with cells of twice the side.
REACH, FILL, ROUNDS = 2, 1.8, 3
#: Candidates (points times window) in a block; most candidates of one point in a window before its cells are halved.
BLOCK, MOST = 1 << 15, 160
_STEPS = 64


def spacing(points: np.ndarray) -> float:
    """A typical distance to the nearest neighbour where points are dense, from a few of them."""
    some = points[:: max(1, len(points) // 48)]
    near = []
    for p in some:
        d = ((points - p) ** 2).sum(1)
        near.append(d[d > 0].min())
    return float(np.sqrt(np.quantile(near, 0.25)))


def weights(points: np.ndarray, scale: float) -> np.ndarray:
    """Tiny weights from the coordinates, far below what tells circles apart and far above rounding; two diagonals of a
    lattice's square then differ by less than rounding in about one square of a million."""
    raw = np.ascontiguousarray(points).view(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), np.uint64)
        for k in (0, 1):
            h = (h ^ raw[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(float) / (1 << 53) * scale * scale * 2e-9


class Cells:
    """Points by square cells, with the number of points before each cell."""

    def __init__(self, points: np.ndarray, low: np.ndarray, side: float, size: np.ndarray):
        self.low, self.side, self.points = low, side, points
        self.shape = np.maximum(1, np.ceil(size / side)).astype(np.int64)
        self.at = np.minimum((points - low) // side, self.shape - 1).astype(np.int64)
        key = self.at[:, 0] * self.shape[1] + self.at[:, 1]
        self.order = np.argsort(key, kind="stable")
        self.before = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=self.shape.prod()))])

    def window(self, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, past) positions in order of each row of cells of the windows around cells: (windows, 2 * reach + 1)."""
        rows = at[:, :1] + np.arange(-reach, reach + 1)
        inside = (rows >= 0) & (rows < self.shape[0])
        base = np.where(inside, rows, 0) * self.shape[1]
        a, b = np.maximum(at[:, 1:] - reach, 0), np.minimum(at[:, 1:] + reach + 1, self.shape[1])
        return np.where(inside, self.before[base + a], 0), np.where(inside, self.before[base + b], 0)


def _stars(cells: Cells, own: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triangles (p, q, r) around the points that got a final star, those points)."""
    points = cells.points
    first, past = cells.window(cells.at[own], REACH)
    count = past - first
    total = count.sum(1)
    width = int(total.max())
    # Candidates, padded: the k-th of a window lies in the row of cells where the running sum passes k.
    upto = np.cumsum(count, 1)
    k = np.arange(width)
    row = (k[None, :, None] >= upto[:, None, :]).sum(2)
    real = k < total[:, None]
    row = np.minimum(row, count.shape[1] - 1)
    line = np.arange(len(own))[:, None]
    place = first[line, row] + k - (upto[line, row] - count[line, row])
    cand = cells.order[np.where(real, place, 0)]
    dx, dy = points[cand, 0] - points[own, None, 0], points[cand, 1] - points[own, None, 1]
    real &= cand != own[:, None]
    half = np.where(real, (dx * dx + dy * dy + weight[cand] - weight[own, None]) / 2, np.inf)
    dx, dy = np.where(real, dx, 0.0), np.where(real, dy, 0.0)
    # How far a circle may reach: to the window's sides, or without end where the window ends at the domain's border.
    low, high = cells.at[own] - REACH, cells.at[own] + REACH + 1
    here = points[own] - cells.low
    down = np.where(low > 0, here - low * cells.side, np.inf)
    up = np.where(high < cells.shape, high * cells.side - here, np.inf)

    live = np.flatnonzero(total > 3)
    start = half[live].argmin(1) if len(live) else np.zeros(0, np.int64)
    at, out, final = start.copy(), [], []
    sub = (dx[live], dy[live], half[live])
    for _ in range(_STEPS):
        if not len(live):
            break
        x, y, h = sub
        i = np.arange(len(live))
        qx, qy = x[i, at], y[i, at]
        a = h[i, at] / (qx * qx + qy * qy)
        cross = qx[:, None] * y
        cross -= qy[:, None] * x
        top = (-a * qx)[:, None] * x
        top -= (a * qy)[:, None] * y
        top += h
        with np.errstate(divide="ignore", invalid="ignore"):
            top /= cross
        top[cross <= 0] = np.inf
        top[i, at] = np.inf
        nxt = top.argmin(1)
        least = np.minimum(top[i, nxt], 1e300)
        cx, cy = a * qx - least * qy, a * qy + least * qx
        with np.errstate(over="ignore"):
            r = np.sqrt(cx * cx + cy * cy) * (1 + 1e-9)
        d, u = down[live], up[live]
        ok = (least < 1e300) & (r - cx <= d[:, 0]) & (r - cy <= d[:, 1]) & (r + cx <= u[:, 0]) & (r + cy <= u[:, 1])
        row_of = live
        out.append(np.column_stack([row_of, cand[row_of, at], cand[row_of, nxt]])[ok])
        closed = ok & (nxt == start)
        final.append(live[closed])
        stay = ok & ~closed
        if stay.all():
            at = nxt
        else:
            live, at, start, sub = live[stay], nxt[stay], start[stay], tuple(v[stay] for v in sub)
    done = np.zeros(len(own), bool)
    if final:
        done[np.concatenate(final)] = True
    tri = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    tri = tri[done[tri[:, 0]]]
    tri[:, 0] = own[tri[:, 0]]
    return tri, own[done]


def _empty(points: np.ndarray, order: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Which triangles have a circle with no point inside; order: the points by x."""
    (ax, ay), (bx, by), (cx, cy) = (points[tri[:, k]].T for k in range(3))
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    d = 2 * (bx * cy - by * cx)
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    r2 = ux * ux + uy * uy
    xs, ys, out = points[order, 0], points[order, 1], np.ones(len(tri), bool)
    reach, least = np.sqrt(r2), r2 * (1 - 1e-9)
    mx, my = ax + ux, ay + uy
    some = order[:: max(1, len(order) // 256)]  # a few points turn most of the others away
    out[(((points[some, 0] - mx[:, None]) ** 2 + (points[some, 1] - my[:, None]) ** 2 < least[:, None]) & (some != tri[:, :1]) & (some != tri[:, 1:2]) & (some != tri[:, 2:])).any(1)] = False
    first, past = np.searchsorted(xs, mx - reach, "left"), np.searchsorted(xs, mx + reach, "right")
    for i in np.flatnonzero(out).tolist():
        for cut in range(first[i], past[i], 1 << 14):
            to = min(past[i], cut + (1 << 14))
            inside = np.flatnonzero((xs[cut:to] - mx[i]) ** 2 + (ys[cut:to] - my[i]) ** 2 < least[i]) + cut
            if len(inside) and not set(order[inside].tolist()) <= set(tri[i].tolist()):
                out[i] = False
                break
    return out


def triangles(points: np.ndarray, sweep) -> np.ndarray:
    """Delaunay triangles (positions, in turning order) of distinct planar points, a row each; sweep: triangulates the few
    points whose stars stay open. Collinear input has none."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), np.int64)
    low, size = points.min(0), np.ptp(points, 0)
    area = max(size[0] * size[1], 1e-12 * max(size) ** 2)
    if n < 64 or not area:
        return np.array(sweep(points), np.int64).reshape(-1, 3)
    weight = weights(points, spacing(points))
    side = np.sqrt(FILL * area / n)
    open_, found, done = np.arange(n), [], np.zeros(n, bool)
    finer = np.zeros(0, np.int64)
    for level in (*range(ROUNDS), -1, -2, -3, -4):  # larger cells for open stars, then smaller ones where points are dense
        own = open_ if level >= 0 else finer
        if not len(own):
            continue
        step = side * 2.0**level
        if np.prod(np.ceil(size / step)) > 64 * n:
            continue
        cells = Cells(points, low, step, size)
        first, past = cells.window(cells.at[own], REACH)
        width = (past - first).sum(1)
        if level == 0:
            finer = own[width > MOST]
        elif level < 0:
            finer = own[width > MOST]
        own = own[width <= MOST * 4 ** max(level, 0)]
        width = (lambda w: w[w <= MOST * 4 ** max(level, 0)])(width)
        order = np.argsort(width, kind="stable")
        own, width = own[order], width[order]
        cut = 0
        while cut < len(own):
            past_ = min(len(own), cut + max(1, BLOCK // max(1, int(width[min(len(own) - 1, cut + BLOCK // max(1, int(width[cut]) or 1))]))))
            tri, stars = _stars(cells, own[cut:past_], weight)
            found.append(tri)
            done[stars] = True
            cut = past_
        open_ = np.flatnonzero(~done)
        finer = finer[~done[finer]]
        if len(open_) < 3 or (level >= 0 and len(open_) <= max(64, 2 * int(np.sqrt(n)))):
            if not len(finer):
                break
    tri = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    # Each triangle once: from the star of its smallest final corner.
    p, q, r = tri.T
    tri = tri[(~done[q] | (p < q)) & (~done[r] | (p < r))]
    rest = np.flatnonzero(~done)
    if len(rest) >= 3:
        own = rest[np.array(sweep(points[rest]), np.int64).reshape(-1, 3)]
        order = np.argsort(points[:, 0], kind="stable")
        tri = np.concatenate([tri, own[_empty(points, order, own)]])
    return tri
