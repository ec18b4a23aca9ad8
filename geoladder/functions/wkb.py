"""Well-known binary: reading, writing and flattening.

A parsed geometry is (type code, parts); a part is (simple type, rings) with rings as (n, 2) arrays. Collections are
flattened into the parts of their members. Z and M values and an SRID are skipped.
"""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINE: "MultiLineString", MULTIPOLYGON: "MultiPolygon", COLLECTION: "GeometryCollection"}
DIMENSION = {POINT: 0, LINE: 1, POLYGON: 2}
Part = tuple[int, list[np.ndarray]]


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def head(self) -> tuple[str, int, int]:
        """(byte order, base type, values per point)."""
        if self.at + 5 > len(self.data):
            raise ValueError("the geometry ends inside a header")
        order = "<" if self.data[self.at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", self.data, self.at + 1)
        self.at += 5
        flags, iso = code >> 28, code & 0x0FFFFFFF
        if flags & 2:
            self.at += 4  # SRID
        extra = (1 if flags & 8 else 0) + (1 if flags & 4 else 0)
        extra += {0: 0, 1: 1, 2: 1, 3: 2}.get(iso // 1000, 0)
        return order, iso % 1000, 2 + extra

    def count(self, order: str) -> int:
        if self.at + 4 > len(self.data):
            raise ValueError("the geometry ends inside a count")
        (n,) = struct.unpack_from(order + "I", self.data, self.at)
        self.at += 4
        return n

    def points(self, order: str, n: int, width: int) -> np.ndarray:
        size = 8 * n * width
        if self.at + size > len(self.data):
            raise ValueError("the geometry ends inside its coordinates")
        xy = np.frombuffer(self.data, order + "f8", n * width, self.at).reshape(n, width)[:, :2]
        self.at += size
        return xy.astype(np.float64)

    def geometry(self) -> tuple[int, list[Part]]:
        order, kind, width = self.head()
        if kind == POINT:
            p = self.points(order, 1, width)
            return kind, [] if np.isnan(p).any() else [(POINT, [p])]
        if kind == LINE:
            return kind, [(LINE, [self.points(order, self.count(order), width)])]
        if kind == POLYGON:
            return kind, [(POLYGON, [self.points(order, self.count(order), width) for _ in range(self.count(order))])]
        if kind in (MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION):
            parts: list[Part] = []
            for _ in range(self.count(order)):
                parts += self.geometry()[1]
            return kind, parts
        raise ValueError(f"unknown geometry type {kind}")


def parse(data: bytes) -> tuple[int, list[Part]]:
    """(type code, parts) of a WKB value; parts without points are left out."""
    kind, parts = _Cursor(bytes(data)).geometry()
    clean = [(k, [r for r in rings if len(r)]) for k, rings in parts]
    return kind, [(k, rings) for k, rings in clean if rings]


def _simple(kind: int, rings: list[np.ndarray]) -> bytes:
    head = struct.pack("<BI", 1, kind)
    body = b"".join((b"" if kind == POINT else struct.pack("<I", len(r))) + np.ascontiguousarray(r, "<f8").tobytes() for r in rings)
    return head + (struct.pack("<I", len(rings)) if kind == POLYGON else b"") + body


def encode(parts: list[Part], kind: int | None = None) -> bytes:
    """Little-endian WKB of parts: a simple type, a multi type, or a collection where kinds differ."""
    kinds = {k for k, _ in parts}
    if kind is None:
        if len(parts) == 1:
            return _simple(*parts[0])
        kind = next(iter(kinds)) + 3 if len(kinds) == 1 else COLLECTION
    if kind in (POINT, LINE, POLYGON) and len(parts) == 1:
        return _simple(*parts[0])
    return struct.pack("<BII", 1, kind, len(parts)) + b"".join(_simple(k, r) for k, r in parts)


def point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, POINT, x, y)


def line(points: Any) -> bytes:
    return _simple(LINE, [np.asarray(points, float).reshape(-1, 2)])


def polygon(*rings: Any) -> bytes:
    return _simple(POLYGON, [np.asarray(r, float).reshape(-1, 2) for r in rings])


def box(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return polygon([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]])


def primitives(data: bytes) -> list[tuple[str, int, list[float], list[int]]]:
    """(kind, part, coordinates, ring starts) of each drawable piece: points, paths, polygons, holedPolygons."""
    out = []
    for i, (kind, rings) in enumerate(parse(data)[1]):
        name = {POINT: "points", LINE: "paths"}.get(kind) or ("polygons" if len(rings) == 1 else "holedPolygons")
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rings])[:-1]]).tolist()
        out.append((name, i, np.concatenate(rings).ravel().tolist(), starts))
    return out


def from_geojson(g: dict) -> bytes | None:
    """WKB of a GeoJSON geometry or feature; None if it has no known type."""
    if g.get("type") == "Feature":
        return from_geojson(g["geometry"]) if g.get("geometry") else None
    xy = lambda c: np.array([p[:2] for p in c], float).reshape(-1, 2)
    c = g.get("coordinates")
    match g.get("type"):
        case "Point":
            return encode([(POINT, [xy([c])])])
        case "LineString":
            return encode([(LINE, [xy(c)])])
        case "Polygon":
            return encode([(POLYGON, [xy(r) for r in c])])
        case "MultiPoint":
            return encode([(POINT, [xy([p])]) for p in c], MULTIPOINT)
        case "MultiLineString":
            return encode([(LINE, [xy(r)]) for r in c], MULTILINE)
        case "MultiPolygon":
            return encode([(POLYGON, [xy(r) for r in p]) for p in c], MULTIPOLYGON)
        case "GeometryCollection":
            parts = [p for m in g.get("geometries", []) if (w := from_geojson(m)) for p in parse(w)[1]]
            return encode(parts, COLLECTION)
    return None
