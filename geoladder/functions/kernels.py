"""Geometry kernels in NumPy, on parsed geometries (see ``wkb``).

Vertices of simplified shapes need not equal those of other libraries. What is promised: the dimension of a geometry stays,
nothing is empty, shapes stay within the padded box, and simple rings stay simple.
"""

from __future__ import annotations

import numpy as np

from geoladder.functions import wkb
from geoladder.functions.wkb import LINE, POINT, POLYGON, Part


def ring_area(r: np.ndarray) -> float:
    """Signed area of a closed ring; coordinates are taken relative to the first point."""
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1])) / 2


def area(parts: list[Part]) -> float:
    total = 0.0
    for kind, rings in parts:
        if kind == POLYGON:
            total += abs(ring_area(rings[0])) - sum(abs(ring_area(r)) for r in rings[1:])
    return total if np.isfinite(total) else 0.0


def length(parts: list[Part]) -> float:
    """Length of lines and of polygon boundaries."""
    total = sum(float(np.hypot(*np.diff(r, axis=0).T).sum()) for kind, rings in parts if kind != POINT for r in rings)
    return total if np.isfinite(total) else 0.0


def bounds(parts: list[Part]) -> tuple[float, float, float, float]:
    if not parts:
        return (np.nan,) * 4
    xy = np.concatenate([r for _, rings in parts for r in rings])
    (x0, y0), (x1, y1) = xy.min(0), xy.max(0)
    return float(x0), float(y0), float(x1), float(y1)


def dimension(parts: list[Part]) -> int:
    """0, 1 or 2, the highest of a collection; -1 for nothing."""
    return max((wkb.DIMENSION[k] for k, _ in parts), default=-1)


def line_midpoint(parts: list[Part]) -> tuple[float, float] | None:
    """The point halfway along the longest line."""
    lines = [r for k, rings in parts if k == LINE for r in rings if len(r) > 1]
    if not lines:
        return None
    r = max(lines, key=lambda q: np.hypot(*np.diff(q, axis=0).T).sum())
    step = np.hypot(*np.diff(r, axis=0).T)
    along = np.concatenate([[0.0], np.cumsum(step)])
    half = along[-1] / 2
    return float(np.interp(half, along, r[:, 0])), float(np.interp(half, along, r[:, 1]))


def _crossings(rings: list[np.ndarray], y: float) -> np.ndarray:
    xs = []
    for r in rings:
        a, b = r[:-1], r[1:]
        hit = (a[:, 1] <= y) != (b[:, 1] <= y)
        a, b = a[hit], b[hit]
        xs.append(a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))
    return np.sort(np.concatenate(xs)) if xs else np.zeros(0)


def point_on_surface(parts: list[Part]) -> tuple[float, float] | None:
    """The middle of the widest stretch inside the largest polygon at half its height."""
    polygons = [rings for k, rings in parts if k == POLYGON]
    if not polygons:
        return None
    rings = max(polygons, key=lambda p: abs(ring_area(p[0])))
    y0, y1 = rings[0][:, 1].min(), rings[0][:, 1].max()
    y = (y0 + y1) / 2
    near = np.unique(np.concatenate([r[:, 1] for r in rings]))
    if y in near and y1 > y0:  # not through a vertex: between it and the next one
        above = near[near > y]
        y_line = (y + above[0]) / 2 if len(above) and len(_crossings(rings, y)) < 2 else y
    else:
        y_line = y
    xs = _crossings(rings, y_line)
    if len(xs) < 2:
        return None
    left, right = xs[0::2][: len(xs) // 2], xs[1::2]
    i = int(np.argmax(right - left))
    return float((left[i] + right[i]) / 2), float(y_line)


def representative(parts: list[Part]) -> tuple[float, float]:
    """On the line or surface where that works, else the middle of the box."""
    d = dimension(parts)
    p = line_midpoint(parts) if d == 1 else point_on_surface(parts) if d == 2 else None
    if p is not None and np.isfinite(p).all():
        return p
    x0, y0, x1, y1 = bounds(parts)
    return (x0 + x1) / 2, (y0 + y1) / 2


# -------------------------------------------------------------------------------------------------------- many at a time

#: Bytes before the coordinates of little-endian plain geometries: of a line the count, of a polygon those of rings and points.
_HEAD = {POINT: 5, LINE: 9, POLYGON: 13}


def measure_flat(values: list) -> tuple[list[tuple[np.ndarray, tuple]], list[int]]:
    """Measures of the plain ones among WKB values, from flat arrays of all their points: (rows, columns) per type, in the
    order of ``udfs.MEASURES``; and the rows that must be looked at one by one."""
    kinds: dict[int, list[int]] = {POINT: [], LINE: [], POLYGON: []}
    rest: list[int] = []
    for i, v in enumerate(values):
        kind = v[1] if v is not None and len(v) > 20 and v[0] == 1 and v[2:5] == b"\0\0\0" else 0
        plain = kind == POINT and len(v) == 21 or kind == LINE and len(v) == 9 + 16 * int.from_bytes(v[5:9], "little") or kind == POLYGON and v[5:9] == b"\1\0\0\0" and len(v) == 13 + 16 * int.from_bytes(v[9:13], "little")
        (kinds[kind] if plain else rest).append(i)
    out = []
    for kind, rows in kinds.items():
        if not rows:
            continue
        n = np.array([(len(values[i]) - _HEAD[kind]) // 16 for i in rows])
        xy = np.frombuffer(b"".join([values[i][_HEAD[kind] :] for i in rows]), "<f8").reshape(-1, 2)
        start = np.cumsum(n) - n
        fine = np.logical_and.reduceat(np.isfinite(xy).all(1), start)
        if kind != POINT:
            fine &= n > (1 if kind == LINE else 3)
        ok = np.flatnonzero(fine)
        rest += [rows[k] for k in np.flatnonzero(~fine)]
        if not len(ok):
            continue
        inner = np.repeat(fine, n)
        xy, n = xy[inner], n[ok]
        start, rows_ok = np.cumsum(n) - n, np.array(rows)[ok]
        low, high = np.minimum.reduceat(xy, start), np.maximum.reduceat(xy, start)
        zero = np.zeros(len(ok))
        area, length, point = zero, zero, (low + high) / 2
        if kind != POINT:
            of = np.repeat(np.arange(len(ok)), n)
            edge = np.flatnonzero(of[1:] == of[:-1])
            step = np.hypot(*(xy[edge + 1] - xy[edge]).T)
            length = np.bincount(of[edge], step, len(ok))
        if kind == LINE:
            point, odd = _midpoints(xy, start, n, edge, of, step, length, point), np.zeros(0, np.int64)
        elif kind == POLYGON:
            q = xy - xy[start][of]
            area = np.abs(np.bincount(of[edge], q[edge, 0] * q[edge + 1, 1] - q[edge + 1, 0] * q[edge, 1], len(ok))) / 2
            point, odd = _surface_points(xy, of, edge, low, high, point)
        if kind != POINT and len(odd):
            rest += rows_ok[odd].tolist()
            keep = np.ones(len(ok), bool)
            keep[odd] = False
        else:
            keep = slice(None)
        m = len(rows_ok[keep])
        fields = (*low[keep].T, *high[keep].T, area[keep], length[keep], [wkb.DIMENSION[kind]] * m, [True] * m, [wkb.NAMES[kind]] * m, *point[keep].T)
        out.append((rows_ok[keep], fields))
    return out, rest


def _midpoints(xy, start, n, edge, of, step, length, middle) -> np.ndarray:
    """The points halfway along lines; the box's middle where a line has no length."""
    upto = np.cumsum(step)
    first = np.searchsorted(edge, start)
    before = np.where(first > 0, upto[first - 1], 0.0)
    half = before + length / 2
    at = np.clip(np.searchsorted(upto, half), first, first + n - 2)
    e = edge[at]
    t = np.clip((half - (upto[at] - step[at])) / np.where(step[at] > 0, step[at], 1.0), 0, 1)
    return np.where((length > 0)[:, None], xy[e] + t[:, None] * (xy[e + 1] - xy[e]), middle)


def _surface_points(xy, of, edge, low, high, middle) -> tuple[np.ndarray, np.ndarray]:
    """As ``point_on_surface`` for polygons of one ring; and those whose line must go between two vertices."""
    y = (low[:, 1] + high[:, 1]) / 2
    a, b, o = xy[edge], xy[edge + 1], of[edge]
    hit = (a[:, 1] <= y[o]) != (b[:, 1] <= y[o])
    a, b, o = a[hit], b[hit], o[hit]
    x = a[:, 0] + (y[o] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    order = np.lexsort((x, o))
    x, o = x[order], o[order]
    nth = np.arange(len(o)) - np.searchsorted(o, o)
    pair = np.flatnonzero((nth[:-1] % 2 == 0) & (o[1:] == o[:-1])) if len(o) else np.zeros(0, np.int64)
    wide = x[pair + 1] - x[pair]
    # the widest of each, the first of equal ones
    best = pair[np.lexsort((np.arange(len(pair)), -wide, o[pair]))]
    best = best[np.append(True, o[best][1:] != o[best][:-1])] if len(best) else best
    out = middle.copy()
    out[o[best], 0], out[o[best], 1] = (x[best] + x[best + 1]) / 2, y[o[best]]
    none = np.ones(len(y), bool)
    none[o[best]] = False
    return out, np.flatnonzero(none)


# ------------------------------------------------------------------------------------------------------- simplifying


#: Rings and lines of up to so many points are worked on point by point, which costs less than arrays.
SMALL = 12


def _keep_small(p: list, i: int, j: int, tol: float, keep: list) -> None:
    """Marks the points between i and j that stay."""
    (ax, ay), (bx, by) = p[i], p[j]
    dx, dy = bx - ax, by - ay
    size, worst, at = dx * dx + dy * dy, -1.0, i
    for k in range(i + 1, j):
        x, y = p[k]
        t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / size)) if size else 0.0
        off = (x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2
        if off > worst:
            worst, at = off, k
    if worst > tol * tol:
        keep[at] = True
        _keep_small(p, i, at, tol, keep)
        _keep_small(p, at, j, tol, keep)


def douglas_peucker(r: np.ndarray, tol: float) -> np.ndarray:
    """Vertices further than ``tol`` from the chord that would replace them stay; the ends stay."""
    n = len(r)
    if n < 3:
        return r
    if n <= SMALL:
        stay = [True] + [False] * (n - 2) + [True]
        _keep_small(r.tolist(), 0, n - 1, tol, stay)
        return r[stay]
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    todo = [(0, n - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        p, a, b = r[i + 1 : j], r[i], r[j]
        d = b - a
        size = float(np.hypot(*d))
        if size == 0:
            off = np.hypot(*(p - a).T)
        else:
            t = np.clip(((p - a) @ d) / (size * size), 0, 1)
            off = np.hypot(*(p - a - t[:, None] * d).T)
        k = int(np.argmax(off))
        if off[k] > tol:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return r[keep]


#: Pairs of edges that are compared at a time.
PAIRS = 1 << 18


def _side(p: np.ndarray, q: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.sign((q[..., 0] - p[..., 0]) * (s[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (s[..., 0] - p[..., 0]))


def _meet(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> bool:
    """Whether any of the edges i (from a to b) meets the edge j beside it."""
    s1, s2 = _side(a[i], b[i], a[j]), _side(a[i], b[i], b[j])
    s3, s4 = _side(a[j], b[j], a[i]), _side(a[j], b[j], b[i])
    if ((s1 * s2 < 0) & (s3 * s4 < 0)).any():
        return True
    flat = (s1 == 0) | (s2 == 0) | (s3 == 0) | (s4 == 0)
    for x, y in ((i[flat], j[flat]), (j[flat], i[flat])):  # touching ends, or edges on one line
        lo, hi = np.minimum(a[x], b[x]), np.maximum(a[x], b[x])
        if any(((_side(a[x], b[x], p) == 0) & (lo <= p).all(1) & (p <= hi).all(1)).any() for p in (a[y], b[y])):
            return True
    return False


def _close_pairs(a: np.ndarray, b: np.ndarray):
    """Pairs (i < j) of edges whose boxes meet, in blocks: edges sorted by their low end along one axis, each
    against those that begin before it ends."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    # the axis along which edges overlap least
    axis = int(np.argmin((hi - lo).sum(0) / np.maximum(hi.max(0) - lo.min(0), np.finfo(float).tiny)))
    order = np.argsort(lo[:, axis], kind="stable")
    until = np.searchsorted(lo[order, axis], hi[order, axis], side="right")
    count = until - np.arange(len(order)) - 1
    ends = np.concatenate([[0], np.cumsum(count)])
    for begin in range(0, int(ends[-1]), PAIRS):
        at = np.arange(begin, min(begin + PAIRS, int(ends[-1])))
        x = np.searchsorted(ends, at, side="right") - 1
        u, v = order[x], order[x + 1 + at - ends[x]]
        other = 1 - axis
        near = (lo[u, other] <= hi[v, other]) & (lo[v, other] <= hi[u, other])
        u, v = u[near], v[near]
        yield np.minimum(u, v), np.maximum(u, v)


def _meet_small(p: list, i: int, j: int) -> bool:
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = p[i], p[i + 1], p[j], p[j + 1]
    s1, s2 = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax), (bx - ax) * (dy - ay) - (by - ay) * (dx - ax)
    s3, s4 = (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx), (dx - cx) * (by - cy) - (dy - cy) * (bx - cx)
    if ((s1 < 0 < s2) or (s2 < 0 < s1)) and ((s3 < 0 < s4) or (s4 < 0 < s3)):
        return True
    on = lambda s, x0, y0, x1, y1, x, y: s == 0 and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1)
    return on(s1, ax, ay, bx, by, cx, cy) or on(s2, ax, ay, bx, by, dx, dy) or on(s3, cx, cy, dx, dy, ax, ay) or on(s4, cx, cy, dx, dy, bx, by)


def crosses_itself(r: np.ndarray) -> bool:
    """Whether two edges of a closed ring that are not neighbours meet."""
    n = len(r) - 1
    if n < 4:
        return False
    if n < SMALL:
        p = r.tolist()
        return any(_meet_small(p, i, j) for i in range(n - 2) for j in range(i + 2, n if i else n - 1))
    a, b = r[:-1], r[1:]
    for i, j in [np.triu_indices(n, 2)] if n <= 64 else _close_pairs(a, b):  # few edges: all pairs cost less
        far = (j - i > 1) & ~((i == 0) & (j == n - 1))
        if _meet(a, b, i[far], j[far]):
            return True
    return False


def rings_meet(rings: list[np.ndarray]) -> bool:
    """Whether edges of different rings meet."""
    if len(rings) < 2:
        return False
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    of = np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
    return any(_meet(a, b, i[of[i] != of[j]], j[of[i] != of[j]]) for i, j in _close_pairs(a, b))


def inside(ring: np.ndarray, x: float, y: float) -> bool:
    """Whether a point lies inside a closed ring."""
    a, b = ring[:-1], ring[1:]
    hit = (a[:, 1] <= y) != (b[:, 1] <= y)
    a, b = a[hit], b[hit]
    return bool((a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) > x).sum() % 2)


def simplify_ring(r: np.ndarray, tol: float) -> np.ndarray | None:
    """A ring of at least four points, with a smaller tolerance where the full one would make it cross itself.

    None if it collapses.
    """
    far = int(np.argmax(np.hypot(*(r - r[0]).T)))
    if far in (0, len(r) - 1):
        return None
    simple = None
    for back in (1, 2, 4, 8):
        t = tol / back
        halves = douglas_peucker(r[: far + 1], t), douglas_peucker(r[far:], t)
        out = np.concatenate([halves[0], halves[1][1:]])
        if len(out) < 4:
            return None
        if not crosses_itself(out):
            return out
        simple = simple or crosses_itself(r)
    return out if simple else r


def snap_ring(r: np.ndarray, grid: float) -> np.ndarray | None:
    """Points on multiples of the grid, repeats dropped; None if the ring collapses or crosses itself."""
    s = np.round(r / grid) * grid
    s = s[np.append(True, (np.diff(s, axis=0) != 0).any(1))]
    return s if len(s) >= 4 and abs(ring_area(s)) > 0 and not crosses_itself(s) else None


def loops(ring: np.ndarray) -> list[np.ndarray]:
    """The simple closed rings that a crossing ring runs through: it is cut wherever it meets itself, and each stretch
    between two visits of a place is a ring of its own."""
    n = len(ring) - 1
    a, b = ring[:-1], ring[1:]
    cuts: list[list[tuple[float, tuple[float, float]]]] = [[] for _ in range(n)]
    for i, j in _close_pairs(a, b):
        for u, v in zip(i.tolist(), j.tolist(), strict=True):
            d, e, f = b[u] - a[u], b[v] - a[v], a[v] - a[u]
            cross = d[0] * e[1] - d[1] * e[0]
            if cross == 0:
                continue
            t, w = (f[0] * e[1] - f[1] * e[0]) / cross, (f[0] * d[1] - f[1] * d[0]) / cross
            if 0 <= t <= 1 and 0 <= w <= 1:
                at = tuple(a[u]) if t == 0 else tuple(b[u]) if t == 1 else tuple(a[v]) if w == 0 else tuple(b[v]) if w == 1 else tuple(a[u] + t * d)
                cuts[u].append((t, at))
                cuts[v].append((w, at))
    path: list[tuple[float, float]] = []
    for k in range(n):
        path.append(tuple(a[k]))
        path += [at for _, at in sorted(cuts[k])]
    out, stack, seen = [], [], {}
    for p in [*path, tuple(a[0])]:
        if p in seen:  # back at a place: what lies between is a ring
            loop = [*stack[seen[p] :], p]
            for q in stack[seen[p] + 1 :]:
                seen.pop(q, None)
            del stack[seen[p] + 1 :]
            if len(loop) > 3:
                out.append(np.array(loop))
        else:
            seen[p] = len(stack)
            stack.append(p)
    return [r for r in out if ring_area(r) != 0]


def make_valid(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The polygon as polygons whose outer rings are simple: one that crosses itself is cut into its loops, of which those
    within others vanish. Holes stay with the polygon that they lie in; crossing holes are cut in the same way."""
    holes = [h for r in rings[1:] for h in ([r] if not crosses_itself(r) else loops(r)) if len(h) >= 4 and ring_area(h) != 0]
    if not crosses_itself(rings[0]):
        return [[rings[0], *holes]]
    outer = sorted(loops(rings[0]), key=lambda r: -abs(ring_area(r)))
    whole: list[list[np.ndarray]] = []
    for r in outer:
        x, y = point_on_surface([(POLYGON, [r])]) or tuple(r[0])
        if not any(inside(w[0], x, y) for w in whole):
            whole.append([r])
    for h in holes:
        home = next((w for w in whole if inside(w[0], *(point_on_surface([(POLYGON, [h])]) or tuple(h[0])))), None)
        if home is not None:
            home.append(h)
    return whole


def quad(parts: list[Part], grid: float, tol: float) -> bytes | None:
    """A square on the grid in place of a polygon below the pixel; its side follows the area, from one cell to a pixel."""
    p = point_on_surface(parts)
    if p is None:
        x0, y0, x1, y1 = bounds(parts)
        p = ((x0 + x1) / 2, (y0 + y1) / 2)
    if not np.isfinite(p).all():
        return None
    half_cell = grid / 2
    cx, cy = (float(np.round(v / half_cell) * half_cell) for v in p)
    cells = float(np.clip(np.round(np.sqrt(max(area(parts), 0.0)) / grid), 1, max(1, round(tol / grid))))
    h = cells * half_cell
    return wkb.box(cx - h, cy - h, cx + h, cy + h)


def segment(parts: list[Part], grid: float) -> bytes | None:
    """A line through the middle of the box along its diagonal, at least a cell long."""
    x0, y0, x1, y1 = bounds(parts)
    if not np.isfinite([x0, y0, x1, y1]).all():
        return None
    diagonal = float(np.hypot(x1 - x0, y1 - y0))
    ux, uy = ((x1 - x0) / diagonal, (y1 - y0) / diagonal) if diagonal > 0 else (1.0, 0.0)
    h, mx, my = max(diagonal, grid) / 2, (x0 + x1) / 2, (y0 + y1) / 2
    return wkb.line([[mx - ux * h, my - uy * h], [mx + ux * h, my + uy * h]])


def _overview_lines(parts: list[Part], tol: float, grid: float) -> bytes | None:
    plain, snapped = [], []
    for kind, rings in parts:
        for r in rings if kind == LINE else []:
            s = douglas_peucker(r, tol)
            if len(s) < 2 or not (np.diff(s, axis=0) != 0).any():
                continue
            plain.append((LINE, [s]))
            q = np.round(s / grid) * grid
            q = q[np.append(True, (np.diff(q, axis=0) != 0).any(1))]
            if len(q) > 1:
                snapped.append((LINE, [q]))
    chosen = snapped or plain
    return wkb.encode(chosen) if chosen else segment(parts, grid)


def _coarse_polygon(rings: list[np.ndarray], tol: float, grid: float) -> list[np.ndarray] | None:
    """A polygon's rings, simplified and snapped; where a ring cannot be snapped it stays unsnapped, and where holes would
    meet the outer ring or each other, a smaller tolerance is taken, and the rings as they are in the end. None if the
    outer ring collapses."""
    for t in (tol, tol / 2, tol / 4, tol / 8):
        plain = [simplify_ring(r, t) for r in rings]
        if plain[0] is None:
            return None
        plain = [r for r in plain if r is not None]
        snapped = [q if (q := snap_ring(r, grid)) is not None else r for r in plain]
        for out in (snapped, plain):
            if not rings_meet(out) and all(inside(out[0], *h[0]) for h in out[1:]):
                return out
    return rings


def _overview_polygons(parts: list[Part], tol: float, grid: float) -> bytes | None:
    out: list[Part] = []
    for kind, rings in parts:
        for polygon in make_valid(rings) if kind == POLYGON else []:
            coarse = _coarse_polygon(polygon, tol, grid)
            if coarse is not None:
                out.append((POLYGON, coarse))
    return wkb.encode(out) if out else quad(parts, grid, tol)


def overview(data: bytes, tol: float, grid: float) -> bytes | None:
    """The shape that stands for a geometry in a coarse band, of the same kind and never empty."""
    _, parts = wkb.parse(data)
    d = dimension(parts)
    if d < 0:
        return None
    if d == 0:
        return bytes(data)
    return _overview_lines(parts, tol, grid) if d == 1 else _overview_polygons(parts, tol, grid)
