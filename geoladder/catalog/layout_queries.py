"""Queries of the layout builder: statistics, ranks, bands, order, row groups, boxes, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoladder.catalog import fixtures as X
from geoladder.functions import columns as C
from geoladder.functions import udfs
from geoladder.operators import banding, levels, rowgroups, stats
from geoladder.options import COARSE_SHARE
from geoladder.plans import ladder
from geoladder.session import work_root

REL = 1 / 1500
EXTENT = "e AS (SELECT min(xmin) FILTER (WHERE valid) AS x0, min(ymin) FILTER (WHERE valid) AS y0, max(xmax) FILTER (WHERE valid) AS x1, max(ymax) FILTER (WHERE valid) AS y1, greatest(max(xmax) FILTER (WHERE valid) - min(xmin) FILTER (WHERE valid), 1e-12) AS sx, greatest(max(ymax) FILTER (WHERE valid) - min(ymin) FILTER (WHERE valid), 1e-12) AS sy FROM {t})"


def dataset_extent(spark: SparkSession, d: str) -> DataFrame:
    return stats.extent_frame(X.with_nulls(spark, d))


NULLS = """nulls AS (SELECT id, CASE WHEN gone THEN -1 ELSE dim END AS dim, NOT gone AS valid, CASE WHEN NOT gone THEN xmin END AS xmin, CASE WHEN NOT gone THEN ymin END AS ymin, CASE WHEN NOT gone THEN xmax END AS xmax, CASE WHEN NOT gone THEN ymax END AS ymax,
    CASE WHEN gone THEN 0 ELSE area END AS area, length, CASE WHEN gone THEN 0 ELSE nbytes END AS nbytes, CASE WHEN NOT gone THEN cx END AS cx, CASE WHEN NOT gone THEN cy END AS cy, hash FROM (SELECT *, id % 97 = 0 AS gone FROM boxes))"""
DATASET_EXTENT = f"""WITH {X.BOXES}, {NULLS}, {EXTENT.format(t='nulls')}
    SELECT x0, y0, x1, y1, (SELECT count(*) FROM nulls WHERE valid) AS n_valid, (SELECT count(*) FROM nulls WHERE NOT valid) AS n_missing, (SELECT CAST(sum(nbytes) AS BIGINT) FROM nulls WHERE valid) AS total_bytes, sx AS span_x, sy AS span_y, greatest(sx, sy) AS span FROM e"""


def density_histogram(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    return stats.density_histogram(p, stats.extent(p))


_HISTOGRAM = f"""{X.POINTS}, {EXTENT.format(t='pts')}, cells AS (SELECT CAST(greatest(0, least(127, floor((cx - x0) / sx * 128))) AS BIGINT) AS ix, CAST(greatest(0, least(127, floor((cy - y0) / sy * 128))) AS BIGINT) AS iy, CAST(sum(nbytes) AS BIGINT) AS cell_bytes FROM pts, e GROUP BY 1, 2)"""
DENSITY_HISTOGRAM = f"WITH {_HISTOGRAM} SELECT ix, iy, cell_bytes FROM cells"


def weighted_density_quantile(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    e = stats.extent(p)
    return stats.density_quantile(stats.density_histogram(p, e), e).select(F.round("density", 9).alias("density"))


WEIGHTED_DENSITY_QUANTILE = f"""WITH {_HISTOGRAM}, dense AS (SELECT *, cell_bytes / greatest((sx / 128) * (sy / 128), 1e-30) AS density FROM cells, e),
    run AS (SELECT *, sum(cell_bytes) OVER (ORDER BY density, ix, iy ROWS UNBOUNDED PRECEDING) AS upto, sum(cell_bytes) OVER () AS total FROM dense)
    SELECT round(coalesce(min(density), 0), 9) AS density FROM run WHERE upto >= CAST(0.9 AS DOUBLE) * total"""


def regime_label(spark: SparkSession, d: str) -> DataFrame:
    return stats.regime_frame(X.vertex_boxes(spark, d))


REGIME_LABEL = f"WITH {X.VERTEX_BOXES} SELECT count(*) AS n_valid, CAST(sum(nbytes) AS BIGINT) AS total_bytes, CASE WHEN count(*) = 0 THEN 'empty' WHEN sum(nbytes) / count(*) >= 2000 THEN 'vertex' ELSE 'count' END AS regime FROM vboxes"


def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    m = X.mixed(spark, d).where("dim > 0").withColumn("metric", F.when(F.col("dim") == 2, F.col("area")).otherwise(F.col("length")))
    return banding.percentile_desc(m, "metric", ["dim"], "score").select("id", "score")


PERCENTILE_RANK = f"""WITH {X.MIXED}, m AS (SELECT id, dim, CASE WHEN dim = 2 THEN area ELSE length END AS metric FROM mixed WHERE dim > 0)
    SELECT id, 1 - CAST(rank() OVER (PARTITION BY dim ORDER BY metric DESC) - 1 AS DOUBLE) / CAST(count(*) OVER (PARTITION BY dim) AS DOUBLE) AS score FROM m"""


def _tie() -> list:
    return [F.col("hash"), F.col("row_id")]


def band0_survivors(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    e = stats.extent(p)
    return banding.survivors(p, e.span * REL, (e.x0, e.y0), _tie(), "metric").where("survivor").select("id", "overview_count")


_CELLS = """cell_of AS (SELECT *, CAST(greatest(0, least(1073741823, floor((cx - x0) / (greatest(sx, sy) * CAST({rel!r} AS DOUBLE))))) AS BIGINT) AS ix, CAST(greatest(0, least(1073741823, floor((cy - y0) / (greatest(sx, sy) * CAST({rel!r} AS DOUBLE))))) AS BIGINT) AS iy FROM {t}, e),
    ranked AS (SELECT *, CASE WHEN valid THEN row_number() OVER (PARTITION BY valid, dim, ix, iy ORDER BY coalesce({metric}, 0) DESC, hash, id) END AS rn, count(*) OVER (PARTITION BY valid, dim, ix, iy) AS pop FROM cell_of)"""
BAND0_SURVIVORS = f"WITH {X.POINTS}, {EXTENT.format(t='pts')}, {_CELLS.format(rel=REL, t='pts', metric='metric')} SELECT id, pop AS overview_count FROM ranked WHERE rn = 1"


def band0_count_total(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    e = stats.extent(p)
    s = banding.survivors(p, e.span * REL, (e.x0, e.y0), _tie(), "metric")
    return s.agg(F.count_if("survivor").alias("survivors"), F.sum("overview_count").alias("total"), F.count("*").alias("n_valid"))


BAND0_COUNT_TOTAL = f"WITH {X.POINTS}, {EXTENT.format(t='pts')}, {_CELLS.format(rel=REL, t='pts', metric='metric')} SELECT count(*) FILTER (WHERE rn = 1) AS survivors, CAST(sum(pop) FILTER (WHERE rn = 1) AS BIGINT) AS total, count(*) AS n_valid FROM ranked"


def fraction_bands(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    n = p.count()
    return banding.ranked_bands(p, [("metric", True), ("id", False)], ladder.band_edges(n, X.BANDS), rows=n).select("id", "band")


def _edge_case(count: str, place: str, bands: int) -> str:
    """The band of a rank in SQL, with the cumulative shares of the default split."""
    out, total, parts = [], 0.0, (1 << (bands - 1)) - 1
    for b in range(bands - 1):
        total += COARSE_SHARE * (1 << b) / parts
        out.append(f"CASE WHEN {place} >= round_even({count} * CAST({total!r} AS DOUBLE), 0) THEN 1 ELSE 0 END")
    return " + ".join(out) or "0"


FRACTION_BANDS = f"WITH {X.POINTS}, r AS (SELECT id, row_number() OVER (ORDER BY metric DESC, id) - 1 AS place, count(*) OVER () AS n FROM pts) SELECT id, CAST({_edge_case('n', 'place', X.BANDS)} AS INTEGER) AS band FROM r"


def _assigned(df: DataFrame, dims: set[int], importance: str | None = None) -> DataFrame:
    e = stats.extent(df)
    scored, _ = banding.rank_metric(df, dims, False, importance)
    out = banding.assign(scored, X.BANDS, e, True, REL, 4.0, None, _tie())
    return out.select(F.col("row_id").alias("id"), "band", "overview_count")


def band_assignment_polygon(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(X.with_nulls(spark, d), {2})


def band_assignment_line(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(X.segments(spark, d), {1})


def band_assignment_point(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(X.points(spark, d).withColumnRenamed("metric", "price"), {0}, "price")


def band_assignment_unranked(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(X.points(spark, d).drop("metric"), {0})


def band_assignment_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(X.mixed(spark, d), {0, 1, 2})


def _assignment_sql(ctes: str, t: str, score: str, rel: float = REL) -> str:
    return f"""WITH {ctes}, scored AS (SELECT *, {score} AS score FROM {t}), {EXTENT.format(t='scored')}, {_CELLS.format(rel=rel, t='scored', metric='score')},
        losers AS (SELECT id, row_number() OVER (ORDER BY score DESC NULLS LAST, id) - 1 AS place, count(*) OVER () AS n FROM ranked WHERE rn > 1),
        raw AS (SELECT id, 0 AS band, pop AS overview_count FROM ranked WHERE rn = 1 UNION ALL SELECT id, 1 + {_edge_case('n', 'place', X.BANDS - 1)}, 0 FROM losers UNION ALL SELECT id, {X.BANDS - 1}, 0 FROM ranked WHERE rn IS NULL)
        SELECT id, CAST(dense_rank() OVER (ORDER BY band) - 1 AS INTEGER) AS band, CAST(overview_count AS BIGINT) AS overview_count FROM raw"""


BAND_ASSIGNMENT_POLYGON = _assignment_sql(f"{X.BOXES}, {NULLS}", "nulls", "CASE WHEN valid THEN area END")
BAND_ASSIGNMENT_LINE = _assignment_sql(X.SEGMENTS, "segs", "length")
BAND_ASSIGNMENT_POINT = _assignment_sql(X.POINTS, "pts", "metric")
BAND_ASSIGNMENT_UNRANKED = _assignment_sql(X.POINTS, "pts", "CAST(NULL AS DOUBLE)")
BAND_ASSIGNMENT_MIXED = _assignment_sql(
    f"{X.MIXED}, measured AS (SELECT *, CASE WHEN dim = 2 THEN area WHEN dim = 1 THEN length END AS m FROM mixed)",
    "measured",
    "CASE WHEN m IS NOT NULL THEN 1 - CAST(rank() OVER (PARTITION BY dim, m IS NOT NULL ORDER BY m DESC) - 1 AS DOUBLE) / CAST(count(*) OVER (PARTITION BY dim, m IS NOT NULL) AS DOUBLE) END",
)


def points_no_thin(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    e = stats.extent(p)
    return banding.stratified_points(p, X.BANDS, ladder.tolerances(X.BANDS, e.span, 1 / 150, 4.0), (e.x0, e.y0)).select("id", "band")


def _strata() -> str:
    out, before = "", "SELECT id, cx, cy, CAST(NULL AS INTEGER) AS band FROM pts"
    for b in range(X.BANDS - 1):
        size = f"(greatest(sx, sy) * CAST({1 / 150!r} AS DOUBLE) / CAST({4.0**b!r} AS DOUBLE))"
        out += f", s{b} AS (SELECT id, cx, cy, CASE WHEN band IS NULL AND id = min(id) FILTER (WHERE band IS NULL) OVER (PARTITION BY floor((cx - x0) / {size}), floor((cy - y0) / {size})) THEN {b} ELSE band END AS band FROM ({before}), e)"
        before = f"SELECT id, cx, cy, band FROM s{b}"
    return out


POINTS_NO_THIN = f"WITH {X.POINTS}, {EXTENT.format(t='pts')}{_strata()} SELECT id, CAST(coalesce(band, {X.BANDS - 1}) AS INTEGER) AS band FROM s{X.BANDS - 2}"


def attribute_rank(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d).withColumn("weight", F.when(F.col("id") % 50 != 0, F.col("metric"))).drop("metric")
    scored, _ = banding.rank_metric(p, {0}, False, "weight")
    placed = banding.numbered(scored, [("score", True), ("id", False)], "place")
    return placed.select("id", (F.col("score") == float("-inf")).alias("least"), (F.col("place") + 1).cast("int").alias("place"))


ATTRIBUTE_RANK = f"WITH {X.POINTS}, s AS (SELECT id, CASE WHEN id % 50 <> 0 THEN metric ELSE CAST('-infinity' AS DOUBLE) END AS score FROM pts) SELECT id, score = CAST('-infinity' AS DOUBLE) AS least, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS place FROM s"


def band_renumber(spark: SparkSession, d: str) -> DataFrame:
    o = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3 * 2 + 1).cast("int").alias("band"))
    return banding.renumber(o).select("id", "band")


BAND_RENUMBER = "SELECT o_orderkey AS id, CAST(dense_rank() OVER (ORDER BY o_custkey % 3 * 2 + 1) - 1 AS INTEGER) AS band FROM orders"


def hilbert_order(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    e = stats.extent(p)
    p = p.select("id", C.quantise(F.col("cx"), e.x0, e.span_x).alias("hx"), C.quantise(F.col("cy"), e.y0, e.span_y).alias("hy"))
    return p.withColumn("hilbert", C.hilbert(F.col("hx"), F.col("hy")))


HILBERT_ORDER = f"""WITH RECURSIVE {X.POINTS}, {EXTENT.format(t='pts')}, q AS (SELECT id, CAST(greatest(0, least(65535, floor((cx - x0) / sx * 65535))) AS BIGINT) AS hx, CAST(greatest(0, least(65535, floor((cy - y0) / sy * 65535))) AS BIGINT) AS hy FROM pts, e),
    fold(id, b, x, y, h) AS (SELECT id, 15, hx, hy, CAST(0 AS BIGINT) FROM q
        UNION ALL SELECT id, b - 1,
            CASE WHEN (y >> b) & 1 = 1 THEN x WHEN (x >> b) & 1 = 1 THEN 65535 - y ELSE y END,
            CASE WHEN (y >> b) & 1 = 1 THEN y WHEN (x >> b) & 1 = 1 THEN 65535 - x ELSE x END,
            h + (CAST(1 AS BIGINT) << (2 * b)) * xor(3 * ((x >> b) & 1), (y >> b) & 1)
        FROM fold WHERE b >= 0)
    SELECT id, hx, hy, h AS hilbert FROM q JOIN fold USING (id) WHERE b = -1"""


def coarse_ntile_groups(spark: SparkSession, d: str) -> DataFrame:
    return X.grouped(spark, d).select("id", "rg")


COARSE_NTILE_GROUPS = f"WITH {X.GROUPED} SELECT id, rg FROM grouped"


def byte_budget_groups(spark: SparkSession, d: str) -> DataFrame:
    return rowgroups.greedy_groups(X.vertex_boxes(spark, d).select("id", "nbytes"), ["id"], "nbytes", 20000).select("id", "rg")


BYTE_BUDGET_GROUPS = f"""WITH RECURSIVE {X.VERTEX_BOXES}, o AS (SELECT id, nbytes, row_number() OVER (ORDER BY id) AS i FROM vboxes),
    step(i, id, rg, held) AS (SELECT i, id, 0, nbytes FROM o WHERE i = 1 UNION ALL SELECT o.i, o.id, CASE WHEN held >= 20000 THEN rg + 1 ELSE rg END, CASE WHEN held >= 20000 THEN o.nbytes ELSE held + o.nbytes END FROM step JOIN o ON o.i = step.i + 1)
    SELECT id, CAST(rg AS INTEGER) AS rg FROM step"""


def row_offsets(spark: SparkSession, d: str) -> DataFrame:
    return rowgroups.row_offsets(X.grouped(spark, d).groupBy("rg").agg(F.count("*").alias("rows")))


ROW_OFFSETS = f"WITH {X.GROUPS} SELECT rg, rows, row_start, row_end FROM groups"


def rowgroup_to_band(spark: SparkSession, d: str) -> DataFrame:
    return X.groups(spark, d).select("rg", "band")


ROWGROUP_TO_BAND = f"WITH {X.GROUPS} SELECT rg, band FROM groups"


def bbox_padding(spark: SparkSession, d: str) -> DataFrame:
    b = X.boxes(spark, d).withColumn("band", (F.col("id") % 4).cast("int"))
    tols = ladder.tolerances(4, 128.0, 1 / 16, 4.0)
    pad = rowgroups.padding(F.col("band"), rowgroups.pads(tols, ladder.grids(tols), True))
    return b.select("id", (F.col("xmin") - pad).alias("xmin"), (F.col("ymin") - pad).alias("ymin"), (F.col("xmax") + pad).alias("xmax"), (F.col("ymax") + pad).alias("ymax"))


BBOX_PADDING = f"WITH {X.BOXES}, p AS (SELECT *, CAST(CASE id % 4 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 0.25 ELSE 0 END AS DOUBLE) AS pad FROM boxes) SELECT id, xmin - pad AS xmin, ymin - pad AS ymin, xmax + pad AS xmax, ymax + pad AS ymax FROM p"


def _box_bytes() -> F.Column:
    return udfs.box_wkb("xmin", "ymin", "xmax", "ymax")


def quad_fallback(spark: SparkSession, d: str) -> DataFrame:
    m = X.boxes(spark, d).withColumn("m", udfs.measures(udfs.quad(_box_bytes(), F.lit(1.2), F.lit(0.3))))
    return m.select("id", *[F.round(f"m.{c}", 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


QUAD_FALLBACK = f"""WITH {X.BOXES}, q AS (SELECT id, round_even(x / CAST(0.15 AS DOUBLE), 0) * CAST(0.15 AS DOUBLE) AS qx, round_even(y / CAST(0.15 AS DOUBLE), 0) * CAST(0.15 AS DOUBLE) AS qy, greatest(1, least(4, round_even(sqrt(area) / CAST(0.3 AS DOUBLE), 0))) * CAST(0.15 AS DOUBLE) AS half FROM boxes)
    SELECT id, round(qx - half, 6) AS xmin, round(qy - half, 6) AS ymin, round(qx + half, 6) AS xmax, round(qy + half, 6) AS ymax FROM q"""


def segment_fallback(spark: SparkSession, d: str) -> DataFrame:
    s = X.segments(spark, d).withColumn("m", udfs.measures(udfs.segment(udfs.segment_wkb("xmin", "ymin", "xmax", "ymax"), F.lit(2.5))))
    return s.select("id", *[F.round(f"m.{c}", 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax", "length")])


SEGMENT_FALLBACK = f"""WITH {X.SEGMENTS}, s AS (SELECT *, greatest(length, 2.5) / 2 AS half FROM segs)
    SELECT id, round(cx - half / length, 6) AS xmin, round(cy - d * half / length, 6) AS ymin, round(cx + half / length, 6) AS xmax, round(cy + d * half / length, 6) AS ymax, round(2 * half, 6) AS length FROM s"""


def snap_grid(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    e = stats.extent(p)
    grids = ladder.grids(ladder.tolerances(X.BANDS, e.span, REL, 4.0))
    out = p.select("id", "cx", "cy", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(g).alias("grid")) for b, g in enumerate(grids)])).alias("g"))
    place = lambda c: F.rint(F.col(c) / F.col("g.grid")).cast("bigint")
    return out.select("id", "g.band", place("cx").alias("sx"), place("cy").alias("sy"))


SNAP_GRID = f"""WITH {X.POINTS}, {EXTENT.format(t='pts')}, g AS (SELECT b AS band, greatest(sx, sy) * CAST({REL!r} AS DOUBLE) / pow(CAST(4 AS DOUBLE), b) / 4 AS grid FROM e, (VALUES (0), (1), (2)) AS v(b))
    SELECT id, band, CAST(round_even(cx / grid, 0) AS BIGINT) AS sx, CAST(round_even(cy / grid, 0) AS BIGINT) AS sy FROM pts, g"""


def wkb_roundtrip_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = X.boxes(spark, d).withColumn("wkb", _box_bytes())
    m = b.withColumn("m", udfs.measures("wkb"))
    return m.select("id", "m.xmin", "m.ymin", "m.xmax", "m.ymax", F.round("m.area", 6).alias("area"), F.round("m.length", 6).alias("length"), F.col("m.dim").alias("dim"), F.octet_length("wkb").alias("nbytes"), F.round("m.rx", 6).alias("rx"), F.round("m.ry", 6).alias("ry"))


WKB_ROUNDTRIP_BOUNDS = f"WITH {X.BOXES} SELECT id, xmin, ymin, xmax, ymax, round(area, 6) AS area, round(length, 6) AS length, dim, CAST(nbytes AS INTEGER) AS nbytes, round(x, 6) AS rx, round(y, 6) AS ry FROM boxes"


def geometry_types(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d).select(udfs.point_wkb("xmin", "ymin").alias("g"))
    b = X.boxes(spark, d).select(_box_bytes().alias("g"))
    s = X.segments(spark, d).select(udfs.segment_wkb("xmin", "ymin", "xmax", "ymax").alias("g"))
    return p.union(b).union(s).select(udfs.measures("g").getField("gtype").alias("gtype")).groupBy("gtype").agg(F.count("*").alias("n"))


GEOMETRY_TYPES = "SELECT 'Point' AS gtype, count(*) AS n FROM orders UNION ALL SELECT 'Polygon', count(*) FROM part UNION ALL SELECT 'LineString', count(*) FROM events"


def flatten_primitives(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d).select("id", udfs.point_wkb("xmin", "ymin").alias("g"))
    b = X.boxes(spark, d).select("id", _box_bytes().alias("g"))
    s = X.segments(spark, d).select("id", udfs.segment_wkb("xmin", "ymin", "xmax", "ymax").alias("g"))
    flat = p.union(b).union(s).select("id", F.explode(udfs.primitives("g")).alias("p"))
    return flat.groupBy(F.col("p.kind").alias("kind")).agg(F.count("*").alias("primitives"), F.sum(F.size("p.coords") / 2).cast("bigint").alias("vertices"), F.countDistinct("id").alias("features"))


FLATTEN_PRIMITIVES = "SELECT 'points' AS kind, count(*) AS primitives, count(*) AS vertices, count(*) AS features FROM orders UNION ALL SELECT 'polygons', count(*), 5 * count(*), count(*) FROM part UNION ALL SELECT 'paths', count(*), 2 * count(*), count(*) FROM events"


def geojson_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Squares written as GeoJSON give the same primitives as WKB."""
    b = X.boxes(spark, d)
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))
    text = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    same = udfs.primitives(udfs.geojson_wkb(text)) == udfs.primitives(_box_bytes())
    return b.select("id", same.alias("same"))


GEOJSON_FLATTEN = "SELECT p_partkey AS id, true AS same FROM part"


def level_table(spark: SparkSession, d: str) -> DataFrame:
    from geoladder.plans import planner

    rows = X.grouped(spark, d)
    bands = planner.stamp_bands(rows.select("rg").distinct(), X.levels(spark)).select(F.col("rg").alias("__rg"), "band")
    rows = rows.join(F.broadcast(bands), F.col("rg") == F.col("__rg"))  # a row per row group
    t = levels.level_frame(rows)
    return t.select("level", "feature_count", "row_group_end", "nbytes", *[F.col(f"extent.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


LEVEL_TABLE = f"WITH {X.GROUPS} SELECT band AS level, CAST(sum(rows) AS BIGINT) AS feature_count, max(rg) AS row_group_end, CAST(sum(nbytes) AS BIGINT) AS nbytes, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM groups GROUP BY band"


def rowgroup_bbox(spark: SparkSession, d: str) -> DataFrame:
    g = rowgroups.group_bounds(X.grouped(spark, d), ["rg"])
    return g.select("rg", "rows", "nbytes", *[F.col(f"bbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


ROWGROUP_BBOX = f"WITH {X.GROUPS} SELECT rg, rows, CAST(nbytes AS BIGINT) AS nbytes, xmin, ymin, xmax, ymax FROM groups"


def lat_scaled_area(spark: SparkSession, d: str) -> DataFrame:
    b = X.boxes(spark, d)
    return b.select("id", F.round(C.scaled_area(F.col("area"), F.col("cy") * 10, True), 6).alias("area"))


LAT_SCALED_AREA = f"WITH {X.BOXES} SELECT id, round(area * cos(radians(greatest(-89.9, least(89.9, cy * 10)))), 6) AS area FROM boxes"


def overview_column(spark: SparkSession, d: str) -> DataFrame:
    """Coarse shapes of squares: kind and box, for a tolerance under their size. They keep their four corners."""
    o = X.boxes(spark, d).withColumn("o", udfs.overview(_box_bytes(), F.lit(0.002), F.lit(0.0005)))
    m = o.withColumn("m", udfs.measures("o"))
    return m.select("id", F.col("m.gtype").alias("gtype"), *[F.round(f"m.{c}", 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


OVERVIEW_COLUMN = f"WITH {X.BOXES} SELECT id, 'Polygon' AS gtype, round(xmin, 3) AS xmin, round(ymin, 3) AS ymin, round(xmax, 3) AS xmax, round(ymax, 3) AS ymax FROM boxes"


def convert_levels(spark: SparkSession, d: str) -> DataFrame:
    """A whole conversion of the squares, written and read again: rows and exact bytes of each level."""
    import uuid

    from geoladder.convert import convert
    from geoladder.options import LayoutOptions
    from geoladder.sources.reader import read_layout

    target = f"{work_root(spark)}/geoladder/layout-{uuid.uuid4().hex}"
    src = X.boxes(spark, d).select("id", _box_bytes().alias("geometry"))
    convert(spark, src, target, LayoutOptions(bands=X.BANDS, native_geo=False, coarsest_rel=1 / 20))
    rows = read_layout(spark, target).rows
    return rows.groupBy(F.col("band").cast("int").alias("band")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("geometry")).alias("exact_bytes"), F.count_if(F.col("geom_overview").isNotNull()).alias("shapes"))


CONVERT_LEVELS = f"WITH a AS ({_assignment_sql(X.BOXES, 'boxes', 'area', 1 / 20)}) SELECT band, count(*) AS rows, 93 * count(*) AS exact_bytes, CASE WHEN band < (SELECT max(band) FROM a) THEN count(*) ELSE 0 END AS shapes FROM a GROUP BY band"


FUNCTIONS = [dataset_extent, density_histogram, weighted_density_quantile, regime_label, percentile_rank, band0_survivors, band0_count_total, fraction_bands, band_assignment_polygon, band_assignment_line, band_assignment_point, band_assignment_unranked, band_assignment_mixed, points_no_thin, attribute_rank, band_renumber, hilbert_order, coarse_ntile_groups, byte_budget_groups, row_offsets, rowgroup_to_band, bbox_padding, quad_fallback, segment_fallback, snap_grid, wkb_roundtrip_bounds, geometry_types, flatten_primitives, geojson_flatten, level_table, rowgroup_bbox, lat_scaled_area, overview_column, convert_levels]
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLE_SQL = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
