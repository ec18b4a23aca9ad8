import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoladder.functions import kernels, wkb
from geoladder.functions import kernels as K
from geoladder.functions import wkb as W


def circle(n, r=1.0, cx=0.0, cy=0.0):
    p = [[cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)] for i in range(n)]
    return np.array([*p, p[0]])


def test_parse_kinds():
    assert W.parse(W.point(1, 2))[0] == W.POINT and W.parse(W.box(0, 0, 1, 1))[0] == W.POLYGON
    assert W.parse(struct.pack("<BIdd", 1, 1, math.nan, math.nan)) == (W.POINT, [])
    assert W.parse(struct.pack(">BIdd", 0, 1, 3.0, 4.0))[1][0][1][0].tolist() == [[3.0, 4.0]]
    assert W.parse(struct.pack("<BIddd", 1, 1001, 1.0, 2.0, 9.0))[1][0][1][0].tolist() == [[1.0, 2.0]]
    assert W.parse(struct.pack("<BIIddd", 1, 0x80000001 | 0x20000000, 4326, 1.0, 2.0, 9.0))[1][0][1][0].tolist() == [[1.0, 2.0]]
    many = W.encode([(W.POLYGON, [circle(5)]), (W.POINT, [np.array([[0.0, 0.0]])])])
    kind, parts = W.parse(many)
    assert kind == W.COLLECTION and [k for k, _ in parts] == [W.POLYGON, W.POINT] and K.dimension(parts) == 2
    assert W.parse(struct.pack("<BII", 1, 3, 0)) == (W.POLYGON, [])
    with pytest.raises(ValueError):
        W.parse(W.box(0, 0, 1, 1)[:-3])
    with pytest.raises(ValueError):
        W.parse(struct.pack("<BI", 1, 42))


def test_geojson_equals_wkb():
    ring = circle(7).tolist()
    hole = circle(5, 0.3).tolist()
    for g, w in (
        ({"type": "Point", "coordinates": [1, 2, 3]}, W.point(1, 2)),
        ({"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, W.line([[0, 0], [1, 1]])),
        ({"type": "Polygon", "coordinates": [ring, hole]}, W.polygon(ring, hole)),
        ({"type": "MultiPolygon", "coordinates": [[ring], [hole]]}, W.encode([(W.POLYGON, [np.array(ring)]), (W.POLYGON, [np.array(hole)])])),
        ({"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": [[0, 0], [1, 1]]}}, W.encode([(W.POINT, [np.array([[0.0, 0]])]), (W.POINT, [np.array([[1.0, 1]])])])),
    ):
        assert W.primitives(W.from_geojson(g)) == W.primitives(w)
    assert [k for k, *_ in W.primitives(W.polygon(ring, hole))] == ["holedPolygons"]


def test_measures():
    parts = W.parse(W.polygon(circle(400, 2.0), circle(400, 1.0)))[1]
    assert abs(K.area(parts) - 3 * math.pi) < 0.01
    x, y = K.point_on_surface(parts)
    assert 1 < math.hypot(x, y) < 2
    assert K.line_midpoint(W.parse(W.line([[0, 0], [1, 0], [1, 3]]))[1]) == (1.0, 1.0)
    c = np.array([[0, 0], [4, 0], [4, 4], [3, 4], [3, 1], [1, 1], [1, 4], [0, 4], [0, 0]], float)
    x, y = K.point_on_surface([(W.POLYGON, [c])])
    assert 0 < x < 1 or 3 < x < 4


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 60), st.floats(0.01, 5), st.floats(-50, 50), st.floats(0.01, 3))
def test_overview_keeps_kind_and_box(n, r, c, tol):
    grid = tol / 4
    data = W.polygon(circle(n, r, c, -c))
    out = K.overview(data, tol, grid)
    kind, parts = W.parse(out)
    assert kind == W.POLYGON and parts
    a, b = K.bounds(W.parse(data)[1]), K.bounds(parts)
    pad = max(tol, grid) / 2 + grid / 2 + 1e-9
    assert b[0] >= a[0] - pad and b[1] >= a[1] - pad and b[2] <= a[2] + pad and b[3] <= a[3] + pad
    assert not K.crosses_itself(parts[0][1][0])


def test_fallbacks_and_repair():
    tiny = K.overview(W.box(0, 0, 1e-4, 1e-4), 1.0, 0.25)
    x0, y0, x1, y1 = K.bounds(W.parse(tiny)[1])
    assert (x1 - x0, y1 - y0) == (0.25, 0.25) and (x0 * 8) % 1 == 0
    dot = K.overview(W.line([[1, 1], [1, 1]]), 1.0, 0.25)
    assert W.parse(dot)[0] == W.LINE and abs(K.length(W.parse(dot)[1]) - 0.25) < 1e-12
    star = np.array([[math.cos(4 * math.pi * i / 5) * 4, math.sin(4 * math.pi * i / 5) * 4] for i in range(6)])
    assert K.crosses_itself(star)
    kind, parts = W.parse(K.overview(W.polygon(star), 0.1, 0.02))
    assert kind == W.POLYGON and not K.crosses_itself(parts[0][1][0])
    flat = W.polygon([[0, 0], [1, 1], [2, 2], [0, 0]])
    assert W.parse(K.overview(flat, 0.5, 0.1))[0] == W.POLYGON
    assert K.overview(W.point(3, 4), 1, 1) == W.point(3, 4)
    wiggle = np.array([[i / 10, math.sin(i)] for i in range(100)])
    out = K.overview(W.line(wiggle), 3.0, 0.5)
    assert len(W.parse(out)[1][0][1][0]) < 10
    assert len(K.overview(W.polygon(circle(500, 5)), 0.5, 0.125)) < len(W.polygon(circle(500, 5))) / 4


def test_large_rings_that_cross():
    old = circle(3000, 5.0)
    assert not K.crosses_itself(old)
    knot = old.copy()
    knot[[100, 1600]] = knot[[1600, 100]]
    assert K.crosses_itself(knot)
    valid = K.make_valid([knot])
    assert valid and not any(K.crosses_itself(p[0]) for p in valid)
    assert 0.9 < sum(abs(K.ring_area(p[0])) for p in valid) / abs(K.ring_area(old)) <= 1.001
    near = old.copy()
    near[[700, 701]] = near[[701, 700]]
    assert K.crosses_itself(near) and K.snap_ring(near, 1e-9) is None
    kind, parts = W.parse(K.overview(W.polygon(knot), 1e-9, 1e-9))
    assert kind == W.MULTIPOLYGON and not any(K.crosses_itself(rings[0]) for _, rings in parts)  # cut where it crosses
    # a comb: all teeth overlap along one axis
    comb = np.array([[i / 2, 9.0 * (i % 4 in (1, 2))] for i in range(4000)] + [[2000.0, -1.0], [0.0, -1.0], [0.0, 0.0]])
    assert not K.crosses_itself(comb)
    comb[-3] = [2000.0, 0.0]
    assert not K.crosses_itself(comb)
    comb[-2] = [0.0, 5.0]
    assert K.crosses_itself(comb)
    assert K.crosses_itself(np.array([[0, 0], [2, 2], [4, 0], [4, 2], [0, 2], [0, 0]], float))  # a point on a later edge


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=4, max_size=14))
def test_crossing_equals_all_pairs(points):
    r = np.array([*points, points[0]], float)
    n = len(r) - 1

    def meet(p, q, s, t):
        d = lambda u, v, w: (v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0])
        on = lambda u, v, w: d(u, v, w) == 0 and min(u[0], v[0]) <= w[0] <= max(u[0], v[0]) and min(u[1], v[1]) <= w[1] <= max(u[1], v[1])
        return d(p, q, s) * d(p, q, t) < 0 and d(s, t, p) * d(s, t, q) < 0 or on(p, q, s) or on(p, q, t) or on(s, t, p) or on(s, t, q)

    want = any(meet(r[i], r[i + 1], r[j], r[j + 1]) for i in range(n) for j in range(i + 2, n) if not (i == 0 and j == n - 1))
    assert K.crosses_itself(r) == want
    fine = np.concatenate([r[:-1, None] + (r[1:, None] - r[:-1, None]) * np.arange(16)[None, :, None] / 16]).reshape(-1, 2)
    if (np.diff(r, axis=0) != 0).any(1).all():  # the same ring with 15 more points on each edge: the other way of pairing
        assert K.crosses_itself(np.concatenate([fine, r[:1]])) or not want


def test_measures_of_many_equal_those_of_one():
    """Plain geometries are measured together; the numbers are those of each by itself."""
    from geoladder.functions import udfs

    r = np.random.default_rng(12)
    values = [None, wkb.polygon([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]), wkb.line([[1, 1], [1, 1]]), wkb.point(float("nan"), 1.0), wkb.encode([(wkb.POINT, [np.array([[1.0, 2.0]])])], wkb.MULTIPOINT)]
    for _ in range(300):
        n = int(r.integers(3, 12))
        a = np.sort(r.random(n) * 2 * np.pi)
        ring = np.stack([np.cos(a), np.sin(a)], 1) * (0.3 + r.random((n, 1))) * 10 + r.normal(size=2) * 50
        if r.random() < 0.3:
            ring = np.round(ring)
        values += [wkb.polygon([*ring, ring[0]]), wkb.line(ring), wkb.point(*ring[0]), wkb.box(*ring.min(0), *ring.max(0))]
    got = udfs._measured(values)
    for i, v in enumerate(values):
        for a, b in zip(got.iloc[i], udfs._measure(v)):
            assert (a is None and b is None) or a == b or (isinstance(b, float) and (abs(a - b) <= 1e-9 * max(1.0, abs(b)) or (a != a and b != b))), (i, got.iloc[i].tolist(), udfs._measure(v))


def test_coarse_polygons_keep_what_they_can():
    """A spike, holes, several parts, a crossing ring and many points: none turns into a square above a pixel."""
    square = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]
    area = lambda data: kernels.area(wkb.parse(data)[1])
    spiky = [[0, 0], [100, 0], [100, 50], [160, 50.01], [100, 50.02], [100, 100], [0, 100], [0, 0]]
    assert abs(area(kernels.overview(wkb.polygon(spiky), 1.0, 0.25)) - 10000) < 50
    holed = wkb.polygon(square(0, 0, 100), square(10, 10, 30)[::-1], square(60, 60, 20)[::-1])
    kind, parts = wkb.parse(kernels.overview(holed, 1.0, 0.25))
    assert len(parts[0][1]) == 3 and abs(kernels.area(parts) - (10000 - 900 - 400)) < 1
    many = wkb.encode([(wkb.POLYGON, [np.array(square(0, 0, 50), float)]), (wkb.POLYGON, [np.array(spiky, float) + 500])])
    assert len(wkb.parse(kernels.overview(many, 1.0, 0.25))[1]) == 2
    bow = [[0, 0], [100, 100], [100, 0], [0, 100], [0, 0]]
    kind, parts = wkb.parse(kernels.overview(wkb.polygon(bow), 1.0, 0.25))
    assert len(parts) == 2 and abs(kernels.area(parts) - 5000) < 10 and not any(kernels.crosses_itself(rings[0]) for _, rings in parts)
    t = np.linspace(0, 2 * np.pi, 1001)
    star = np.stack([np.cos(t), np.sin(t)], 1) * (100 + 20 * np.sin(17 * t))[:, None]
    star[-1] = star[0]
    for tol in (0.5, 2.0, 8.0):
        rings = wkb.parse(kernels.overview(wkb.polygon(star), tol, tol / 4))[1][0][1]
        assert 4 < len(rings[0]) < 700 and not kernels.crosses_itself(rings[0]) and abs(abs(kernels.ring_area(rings[0])) / abs(kernels.ring_area(star)) - 1) < 0.1
    # a hole close to the outer ring stays inside of it
    t = np.linspace(0, 2 * np.pi, 201)
    hole = np.stack([np.cos(t), np.sin(t)], 1) * 99.5
    hole[-1] = hole[0]
    outer = np.stack([np.cos(t), np.sin(t)], 1) * 100
    outer[-1] = outer[0]
    parts = wkb.parse(kernels.overview(wkb.polygon(outer, hole[::-1]), 4.0, 1.0))[1]
    assert not kernels.rings_meet(parts[0][1])
    assert kernels.overview(wkb.polygon(square(0, 0, 0.2)), 1.0, 0.25) is not None
