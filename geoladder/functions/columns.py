"""Built-in column expressions: boxes, viewports, Hilbert order, density styling. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]
HILBERT_ORDER = 16
CAMERA_EPSILON = 1e-6


def bbox_struct(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))


def intersects(box: Column, aoi: Box) -> Column:
    """Closed on all edges. On the leaves of a struct column, so the scan can prune by it."""
    return (box["xmin"] <= float(aoi[2])) & (box["xmax"] >= float(aoi[0])) & (box["ymin"] <= float(aoi[3])) & (box["ymax"] >= float(aoi[1]))


def split_at_seam(aoi: Box) -> list[Box]:
    """The parts of a viewport within [-180, 180]: all longitudes, one box, or one on each side of the seam."""
    x0, y0, x1, y1 = (float(v) for v in aoi)
    if x1 - x0 >= 360:
        return [(-180.0, y0, 180.0, y1)]
    west, east = (((x + 180) % 360) - 180 for x in (x0, x1))
    if west <= east:
        return [(west, y0, east, y1)]
    return [(west, y0, 180.0, y1), (-180.0, y0, east, y1)]


def meets_aoi(box: Column, aoi: Box) -> Column:
    parts = [intersects(box, p) for p in split_at_seam(aoi)]
    return parts[0] if len(parts) == 1 else parts[0] | parts[1]


def keep_unknown(box: Column, aoi: Box) -> Column:
    """Of metadata: a box that is not known is never pruned."""
    return box.isNull() | meets_aoi(box, aoi)


def box_area(box: Column) -> Column:
    return F.greatest(box["xmax"] - box["xmin"], F.lit(0.0)) * F.greatest(box["ymax"] - box["ymin"], F.lit(0.0))


def _clamp_axis(low: Column, high: Column, top: float) -> tuple[Column, Column]:
    fit = lambda v: F.greatest(F.lit(-top), F.least(F.lit(top), v))
    a, b = fit(low), fit(high)
    mid = (a + b) / 2
    return F.when(a < b, a).otherwise(F.greatest(F.lit(-top), mid - CAMERA_EPSILON)), F.when(a < b, b).otherwise(F.least(F.lit(top), mid + CAMERA_EPSILON))


def clamp_geographic(box: Column) -> Column:
    """A box within the valid range that is never without width or height."""
    x0, x1 = _clamp_axis(box["xmin"], box["xmax"], 180.0)
    y0, y1 = _clamp_axis(box["ymin"], box["ymax"], 90.0)
    return bbox_struct(x0, y0, x1, y1)


def ring(box: Column) -> Column:
    """The closed outline of a box, five points."""
    p = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    return F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"), p("xmin", "ymin"))


def quantise(value: Column, low: float, span: float) -> Column:
    """Place on the Hilbert grid; what is no number lies at the origin."""
    top = (1 << HILBERT_ORDER) - 1
    scaled = F.floor((value - float(low)) / float(span) * top)
    return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(top), scaled))).cast("bigint")


def hilbert(x: Column, y: Column, order: int = HILBERT_ORDER) -> Column:
    """Distance along the Hilbert curve of grid places, one fold over the bits."""
    side = F.lit((1 << order) - 1).cast("bigint")
    one, three = F.lit(1).cast("bigint"), F.lit(3).cast("bigint")
    big = lambda c: c.cast("bigint")

    def step(s: Column, b: Column) -> Column:
        rx = F.call_function("shiftright", s["x"], b).bitwiseAND(one)
        ry = F.call_function("shiftright", s["y"], b).bitwiseAND(one)
        d = s["d"] + F.call_function("shiftleft", one, b * 2) * (three * rx).bitwiseXOR(ry)
        flip = lambda v: F.when(rx == 1, side - v).otherwise(v)
        turn = ry == 0
        return F.struct(F.when(turn, flip(s["y"])).otherwise(s["x"]).alias("x"), F.when(turn, flip(s["x"])).otherwise(s["y"]).alias("y"), d.alias("d"))

    start = F.struct(big(x).alias("x"), big(y).alias("y"), F.lit(0).cast("bigint").alias("d"))
    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["d"])


def density_radius(count: Column, base: float = 2.5) -> Column:
    """Point radius that grows with the logarithm of a survivor's count, one to five times the base."""
    factor = F.greatest(F.lit(1.0), F.least(F.lit(5.0), 0.6 + 0.5 * F.log2(count.cast("double"))))
    return F.when(count > 0, F.lit(float(base)) * factor).otherwise(F.lit(float(base)))


def density_alpha(count: Column, fallback: float = 180.0) -> Column:
    """Opacity that grows with the logarithm of a survivor's count, 110 to 255."""
    alpha = F.greatest(F.lit(110.0), F.least(F.lit(255.0), 110 + 36 * F.log2(count.cast("double"))))
    return F.when(count > 0, alpha).otherwise(F.lit(float(fallback)))


def scaled_area(area: Column, cy: Column, geographic: bool) -> Column:
    """Area by which polygons are ranked; degrees shrink with the cosine of the latitude."""
    if not geographic:
        return area
    return area * F.cos(F.radians(F.greatest(F.lit(-89.9), F.least(F.lit(89.9), cy))))


def importance(column: Column) -> Column:
    """A numeric attribute as a rank metric; null is least."""
    return F.coalesce(column.cast("double"), F.lit(float("-inf")))


#: The geometry types of WKB, from 1.
TYPE_NAMES = ["Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"]


def type_name(wkb: Column) -> Column:
    """The type's name from a WKB value's header; null for null."""
    byte = lambda i: F.conv(F.hex(F.substring(wkb, i, 1)), 16, 10).cast("int")
    little = byte(1) == 1
    code = F.when(little, byte(2) + 256 * byte(3)).otherwise(byte(5) + 256 * byte(4)) % 1000
    name = F.lit(None).cast("string")
    for i, n in enumerate(TYPE_NAMES, 1):
        name = F.when(code == i, n).otherwise(name)
    return F.when(F.octet_length(wkb) >= 5, name)


def shown(column: Column, kind: str) -> Column:
    """A value as text: null is empty, nested values are JSON."""
    text = F.to_json(column) if kind.startswith(("struct", "array", "map")) else column.cast("string")
    return F.coalesce(text, F.lit(""))
