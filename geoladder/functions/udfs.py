"""Geometry functions as Arrow-batched UDFs and a table function. Everything that SQL can say is in ``columns``."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoladder.functions import kernels, wkb

# Types are spelled out as objects: workers import this module without a session that could parse their names.
BINARY, DOUBLE, INT, STRING = T.BinaryType(), T.DoubleType(), T.IntegerType(), T.StringType()
_FIELDS = [("xmin", DOUBLE), ("ymin", DOUBLE), ("xmax", DOUBLE), ("ymax", DOUBLE), ("area", DOUBLE), ("length", DOUBLE), ("dim", INT), ("valid", T.BooleanType()), ("gtype", STRING), ("rx", DOUBLE), ("ry", DOUBLE)]
MEASURES = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
PIECE = T.StructType([T.StructField("kind", STRING), T.StructField("part", INT), T.StructField("coords", T.ArrayType(DOUBLE)), T.StructField("rings", T.ArrayType(INT))])


def _measure(data: bytes | None) -> tuple:
    nothing = (None, None, None, None, 0.0, 0.0, -1, False, None, None, None)
    if data is None:
        return nothing
    kind, parts = wkb.parse(data)
    if not parts:
        return (*nothing[:8], wkb.NAMES[kind], None, None)
    return (*kernels.bounds(parts), kernels.area(parts), kernels.length(parts), kernels.dimension(parts), True, wkb.NAMES[kind], *kernels.representative(parts))


def _measured(values: list) -> pd.DataFrame:
    """The measures of a batch: plain points, lines and polygons of one ring together, all others one by one."""
    out = {n: np.empty(len(values), object) for n in MEASURES.names}
    flat, rest = kernels.measure_flat(values)
    for rows, cols in flat:
        for n, c in zip(MEASURES.names, cols, strict=True):
            out[n][rows] = c
    for i in rest:
        for n, v in zip(MEASURES.names, _measure(values[i]), strict=True):
            out[n][i] = v
    return pd.DataFrame(out)


@F.pandas_udf(MEASURES)
def measures(data: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Bounds, area, length, dimension, validity, type name and representative point of WKB."""
    for s in data:
        yield _measured(s.tolist())


@F.pandas_udf(BINARY)
def overview(data: pd.Series, tol: pd.Series, grid: pd.Series) -> pd.Series:
    """The coarse shape of WKB for a tolerance and a grid; null without a tolerance."""
    return pd.Series([None if d is None or t is None or t != t else kernels.overview(d, float(t), float(g)) for d, t, g in zip(data, tol, grid, strict=True)], dtype=object)


@F.pandas_udf(BINARY)
def quad(data: pd.Series, tol: pd.Series, grid: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else kernels.quad(wkb.parse(d)[1], float(g), float(t)) for d, t, g in zip(data, tol, grid, strict=True)], dtype=object)


@F.pandas_udf(BINARY)
def segment(data: pd.Series, grid: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else kernels.segment(wkb.parse(d)[1], float(g)) for d, g in zip(data, grid, strict=True)], dtype=object)


def _fixed(head: bytes, numbers: list[np.ndarray]) -> pd.Series:
    """Values of one layout: the same head, then a number from each array."""
    n, size = len(numbers[0]), len(head) + 8 * len(numbers)
    out = np.empty((n, size), np.uint8)
    out[:, : len(head)] = np.frombuffer(head, np.uint8)
    out[:, len(head) :] = np.stack(numbers, 1).astype("<f8").view(np.uint8).reshape(n, -1)
    raw = out.tobytes()
    return pd.Series([raw[i : i + size] for i in range(0, n * size, size)], dtype=object)


@F.pandas_udf(BINARY)
def point_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    """Points, all at once: the bytes of a value lie at fixed places."""
    return _fixed(b"\1\1\0\0\0", [x.to_numpy("<f8"), y.to_numpy("<f8")])


@F.pandas_udf(BINARY)
def box_wkb(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    a, b, c, d = (v.to_numpy("<f8") for v in (x0, y0, x1, y1))
    return _fixed(b"\1\3\0\0\0\1\0\0\0\5\0\0\0", [a, b, c, b, c, d, a, d, a, b])


@F.pandas_udf(BINARY)
def segment_wkb(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return _fixed(b"\1\2\0\0\0\2\0\0\0", [v.to_numpy("<f8") for v in (x0, y0, x1, y1)])


@F.pandas_udf(BINARY)
def geojson_wkb(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else wkb.from_geojson(json.loads(t)) for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(PIECE))
def primitives(data: pd.Series) -> pd.Series:
    """The drawable pieces of WKB, to be exploded; rows keep their own id."""
    return pd.Series([[] if d is None else [{"kind": k, "part": i, "coords": c, "rings": r} for k, i, c, r in wkb.primitives(d)] for d in data], dtype=object)


@F.udtf(returnType=PIECE)
class FlattenWkb:
    """The same as a table function, for SQL: ``SELECT * FROM t, LATERAL flatten_wkb(t.geometry)``."""

    def eval(self, data: bytes):
        if data is not None:
            yield from wkb.primitives(bytes(data))


def register(spark) -> None:
    """Makes the functions known to SQL."""
    for name, f in (("gl_measures", measures), ("gl_overview", overview), ("gl_quad", quad), ("gl_segment", segment), ("gl_point", point_wkb), ("gl_box", box_wkb), ("gl_line", segment_wkb), ("gl_geojson", geojson_wkb), ("gl_primitives", primitives)):
        spark.udf.register(name, f)
    spark.udtf.register("flatten_wkb", FlattenWkb)
