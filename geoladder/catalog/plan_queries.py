"""Queries of the reader: planning, pruning, lookups, facts and meters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoladder.catalog import fixtures as X
from geoladder.functions import columns as C
from geoladder.operators import stats
from geoladder.plans import planner
from geoladder.session import kept, work_root
from geoladder.sources import catalog
from geoladder.streaming import meter

#: Viewports: on the points' frame (customer by price; longitudes up to 180), and across the seam of the globe.
AOI = (20.0, 100000.0, 120.0, 300000.0)
SEAM = (170.0, -60.0, 200.0, 60.0)
HIT = "(NOT known OR (xmin <= 120.0 AND xmax >= 20.0 AND ymin <= 300000.0 AND ymax >= 100000.0))"
PAGE_HIT = "(xmin <= 120.0 AND xmax >= 20.0 AND ymin <= 300000.0 AND ymax >= 100000.0)"


def level_for_zoom(spark: SparkSession, d: str) -> DataFrame:
    zooms = X.table(spark, d, "orders").select((F.col("o_orderkey") % 30).cast("int").alias("zoom")).distinct()
    return planner.level_for_zoom_frame(X.levels(spark), zooms)


LEVEL_FOR_ZOOM = "SELECT DISTINCT CAST(o_orderkey % 30 AS INTEGER) AS zoom, CAST(CASE WHEN o_orderkey % 30 <= 8 THEN 0 WHEN o_orderkey % 30 <= 10 THEN 1 WHEN o_orderkey % 30 <= 12 THEN 2 ELSE 3 END AS INTEGER) AS level FROM orders"


def rowgroup_prune(spark: SparkSession, d: str) -> DataFrame:
    return planner.plan_flat(X.groups(spark, d), AOI, 14).groups.select("rg", "column")


ROWGROUP_PRUNE = f"WITH {X.GROUPS} SELECT rg, 'geometry' AS \"column\" FROM groups WHERE {HIT}"


def seam_split_prune(spark: SparkSession, d: str) -> DataFrame:
    g = X.geo_points(spark, d)
    return g.where(C.meets_aoi(F.col("bbox"), SEAM)).select("id")


SEAM_SPLIT_PRUNE = f"WITH {X.GEO_POINTS} SELECT id FROM geo WHERE y BETWEEN -60 AND 60 AND (x BETWEEN 170 AND 180 OR x BETWEEN -180 AND -160)"


def _extents(groups: DataFrame) -> dict[int, tuple]:
    """Extents of the bands (a row each); that of band 1 is not known."""
    rows = groups.where("bbox is not null").groupBy("band").agg(F.min("bbox.xmin").alias("a"), F.min("bbox.ymin").alias("b"), F.max("bbox.xmax").alias("c"), F.max("bbox.ymax").alias("e")).collect()
    return {r.band: (r.a, r.b, r.c, r.e) for r in rows if r.band != 1}


def band_skip(spark: SparkSession, d: str) -> DataFrame:
    skip = planner.bands_outside(X.info(_extents(X.groups(spark, d))), AOI)
    return X.levels(spark).select("level", F.col("level").isin(sorted(skip) or [-1]).alias("skipped"))


_EXTENTS = f"{X.GROUPS}, ext AS (SELECT band, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM groups WHERE known GROUP BY band), lv AS (SELECT CAST(level AS INTEGER) AS level, coalesce(level <> 1 AND NOT {PAGE_HIT}, false) AS skipped FROM (VALUES (0), (1), (2), (3)) AS v(level) LEFT JOIN ext ON ext.band = level)"
BAND_SKIP = f"WITH {_EXTENTS} SELECT level, skipped FROM lv"


def viewport_read(spark: SparkSession, d: str) -> DataFrame:
    """Plans at three zooms: the groups of the prefix that may meet the viewport, each with its geometry column."""
    g, out = X.groups(spark, d), None
    info = X.info(_extents(g))
    for zoom in (6, 9, 14):
        p = planner.plan_overviews(info, g, AOI, zoom)
        part = p.groups.select(F.lit(zoom).alias("zoom"), "rg", "band", "column", F.lit(p.lod_key).alias("lod_key"))
        out = part if out is None else out.union(part)
    return out


VIEWPORT_READ = f"""WITH {_EXTENTS}, z AS (SELECT * FROM (VALUES (6, 0), (9, 1), (14, 3)) AS v(zoom, target))
    SELECT CAST(zoom AS INTEGER) AS zoom, rg, band, CASE WHEN band < target OR target = 3 THEN 'geometry' ELSE 'geom_overview' END AS "column", 'L' || target || ':' || CASE WHEN target = 3 THEN 'geometry' ELSE 'geom_overview' END AS lod_key
    FROM groups JOIN lv ON lv.level = band, z WHERE band <= target AND NOT skipped AND {HIT}"""


def flat_preview_boxes(spark: SparkSession, d: str) -> DataFrame:
    p = planner.plan_flat(X.groups(spark, d), AOI, 5)
    corner = F.explode(F.transform("ring", lambda q, i: F.struct(i.alias("i"), q["x"].alias("x"), q["y"].alias("y"))))
    return p.groups.select("rg", corner.alias("c")).select("rg", "c.i", "c.x", "c.y")


FLAT_PREVIEW_BOXES = f"WITH {X.GROUPS} SELECT rg, CAST(i AS INTEGER) AS i, CASE WHEN i IN (1, 2) THEN xmax ELSE xmin END AS x, CASE WHEN i IN (2, 3) THEN ymax ELSE ymin END AS y FROM groups, (VALUES (0), (1), (2), (3), (4)) AS v(i) WHERE known AND {PAGE_HIT}"


def page_ranges_merged(spark: SparkSession, d: str) -> DataFrame:
    return planner.merge_pages(X.pages(spark, d), AOI)


PAGE_RANGES_MERGED = f"""WITH {X.PAGES}, hit AS (SELECT * FROM page_t WHERE {PAGE_HIT}), marked AS (SELECT *, CASE WHEN lag(row_end) OVER (PARTITION BY rg ORDER BY row_start) >= row_start THEN 0 ELSE 1 END AS new FROM hit),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY rg ORDER BY row_start) AS run FROM marked) SELECT rg, min(row_start) AS row_start, max(row_end) AS row_end FROM runs GROUP BY rg, run"""


def page_pairing(spark: SparkSession, d: str) -> DataFrame:
    """The leaves' indexes of every group; group 2 has a leaf with other boundaries, group 4 lacks a page, page 0 has no bounds."""
    p = kept(X.pages(spark, d), "pages")
    leaf = F.explode(F.array(*[F.struct(F.lit(n).alias("leaf"), F.col(f"bbox.{n}").alias("v")) for n in ("xmin", "ymin", "xmax", "ymax")]))
    leaves = p.select("rg", "page", "row_start", "row_end", leaf.alias("l")).select("rg", "page", "row_start", "row_end", "l.leaf", "l.v")
    leaves = leaves.where(~((F.col("rg") == 4) & (F.col("page") == 1) & (F.col("leaf") == "ymax")))
    odd = (F.col("rg") == 2) & (F.col("leaf") == "xmax") & (F.col("page") == 0)
    bound = F.when(F.col("page") > 0, F.col("v"))
    leaves = leaves.select("rg", "page", "leaf", F.when(odd, F.col("row_start") + 1).otherwise(F.col("row_start")).alias("row_start"), "row_end", bound.alias("low"), bound.alias("high"))
    out = planner.pair_pages(leaves)
    finite = lambda c: F.when(F.abs(F.col(f"bbox.{c}")) < float("inf"), F.col(f"bbox.{c}"))
    return out.select("rg", "page", "row_start", "row_end", *[finite(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


PAGE_PAIRING = f"WITH {X.PAGES} SELECT rg, page, row_start, row_end, CASE WHEN page > 0 THEN xmin END AS xmin, CASE WHEN page > 0 THEN ymin END AS ymin, CASE WHEN page > 0 THEN xmax END AS xmax, CASE WHEN page > 0 THEN ymax END AS ymax FROM page_t WHERE rg NOT IN (2, 4)"


def page_gate(spark: SparkSession, d: str) -> DataFrame:
    return X.groups(spark, d).where("bbox is not null").select("rg", planner.page_gate(F.col("bbox"), AOI).alias("gate"))


PAGE_GATE = f"WITH {X.GROUPS} SELECT rg, (xmax - xmin) * (ymax - ymin) >= 1.5 * (100.0 * 200000.0) AS gate FROM groups WHERE known"


def count_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Counts of rows of coarse groups from the groups' arrays; 0 for rows that no array covers."""
    rows = X.grouped(spark, d)
    g = rows.join(F.broadcast(planner.counted_groups(X.groups(spark, d), 3).select("rg")), "rg", "left_semi")  # a row per row group
    # a group's array in parts of 65,536 rows
    arrays = g.groupBy("rg", F.floor(F.col("row_index") / 65536)).agg(F.min("row_index").alias("row_start"), (F.max("row_index") + 1).alias("row_end"), F.transform(F.array_sort(F.collect_list(F.struct("row_index", (F.col("id") % 7).cast("int").alias("n")))), lambda s: s["n"]).alias("counts"))
    rows = rows.select("id", F.col("row_index").alias("row_id"))
    return planner.counts_for_rows(rows, arrays).select("id", F.col("count").cast("int").alias("count"))


COUNT_LOOKUP = f"WITH {X.GROUPED} SELECT id, CAST(CASE WHEN rg <= 8 THEN id % 7 ELSE 0 END AS INTEGER) AS count FROM grouped"


def cache_hits_misses(spark: SparkSession, d: str) -> DataFrame:
    ranges = X.table(spark, d, "events").select(F.col("user_id").alias("rg"), F.col("event_type").alias("column")).distinct()
    cached = X.table(spark, d, "events").where("event_id % 3 = 0").select(F.col("user_id").alias("rg"), F.col("event_type").alias("column"))
    return planner.cache_split(ranges, cached, ["rg", "column"])


CACHE_HITS_MISSES = 'SELECT user_id AS rg, event_type AS "column", bool_or(event_id % 3 = 0) AS hit FROM events GROUP BY 1, 2'


def plan_signature(spark: SparkSession, d: str) -> DataFrame:
    g = X.groups(spark, d)
    ranges = g.select("rg", F.when(F.col("band") < 2, F.lit("geom_overview")).alias("column"), F.when(F.col("rg") % 2 == 0, F.concat_ws("-", "row_start", "row_end")).alias("sub"))
    return planner.plan_signature(ranges, "geometry")


PLAN_SIGNATURE = f"""WITH {X.GROUPS}, p AS (SELECT CAST(rg AS VARCHAR) || ':' || CASE WHEN band < 2 THEN 'geom_overview' ELSE 'geometry' END || ':' || CASE WHEN rg % 2 = 0 THEN row_start || '-' || row_end ELSE 'full' END AS part FROM groups) SELECT 'geometry|' || string_agg(part, '|' ORDER BY part) AS signature FROM p"""


def byte_meter(spark: SparkSession, d: str) -> DataFrame:
    m = meter.byte_meter(meter.fetch_log(X.table(spark, d, "events")))
    return m.select("view", "phase", "bytes", "requests", "hits", F.col("scope").cast("int").alias("scope"))


_LOG = "log AS (SELECT event_type AS phase, CAST(floor(value * 1000) AS BIGINT) AS bytes, event_id % 3 = 0 AS cached, user_id AS view, ts AS t, event_id AS id FROM events)"
BYTE_METER = f"WITH {_LOG} SELECT view, phase, CAST(sum(CASE WHEN cached THEN 0 ELSE bytes END) AS BIGINT) AS bytes, count(*) FILTER (WHERE NOT cached) AS requests, count(*) FILTER (WHERE cached) AS hits, CAST(grouping(view, phase) AS INTEGER) AS scope FROM log GROUP BY GROUPING SETS ((view, phase), (phase), ())"


def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return meter.recent(meter.fetch_log(X.table(spark, d, "events"))).select("place", "id", "phase", "bytes")


RECENT_EVENTS = f"WITH {_LOG} SELECT CAST(row_number() OVER (ORDER BY t DESC, id DESC) AS INTEGER) AS place, id, phase, bytes FROM log QUALIFY place <= 300"


def stream_meter(spark: SparkSession, d: str) -> DataFrame:
    """The meter as a stream over the event table, run until all of it is read."""
    import uuid

    schema = X.table(spark, d, "events").schema
    log = meter.fetch_log(spark.readStream.schema(schema).format("parquet").load(f"{d}/event[s].parquet"))
    name = f"meter_{uuid.uuid4().hex}"
    root = f"{work_root(spark)}/geoladder/{name}"

    def keep(batch: DataFrame, _: int) -> None:  # the table as it stands after each trigger
        batch.write.mode("overwrite").parquet(f"{root}/table")

    q = meter.stream_meter(log).writeStream.outputMode("complete").foreachBatch(keep).queryName(name).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/table")


STREAM_METER = f"WITH {_LOG} SELECT date_trunc('hour', t) AS start, phase, CAST(sum(CASE WHEN cached THEN 0 ELSE bytes END) AS BIGINT) AS bytes, count(*) AS requests FROM log GROUP BY 1, 2"


def prune_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return planner.prune_outcomes(X.groups(spark, d), AOI)


PRUNE_OUTCOMES = f"WITH {X.GROUPS} SELECT CASE WHEN NOT known THEN 'no-bbox' WHEN {PAGE_HIT} THEN 'fetched' ELSE 'pruned' END AS outcome, count(*) AS groups, CAST(sum(rows) AS BIGINT) AS rows FROM groups GROUP BY 1"


def _chunks(g: DataFrame) -> DataFrame:
    """Column chunks of the groups: exact ones everywhere, coarse ones in coarse bands."""
    two = F.array(F.struct(F.lit("geometry").alias("column"), F.col("nbytes").alias("nbytes"), F.lit("ZSTD").alias("codec")), F.struct(F.lit("geom_overview").alias("column"), F.when(F.col("band") < 3, F.floor(F.col("nbytes") / 4)).otherwise(0).alias("nbytes"), F.when(F.col("band") < 3, "ZSTD").otherwise("SNAPPY").alias("codec")))
    return g.select("rg", "band", "rows", F.explode(two).alias("c")).select("rg", "band", "rows", "c.column", F.col("c.nbytes").cast("bigint").alias("nbytes"), "c.codec", (F.col("c.nbytes") * 3).cast("bigint").alias("raw_bytes"))


_CHUNKS = f"{X.GROUPS}, chunks AS (SELECT rg, band, rows, 'geometry' AS col, CAST(nbytes AS BIGINT) AS nbytes, 'ZSTD' AS codec FROM groups UNION ALL SELECT rg, band, rows, 'geom_overview', CASE WHEN band < 3 THEN CAST(nbytes AS BIGINT) // 4 ELSE 0 END, CASE WHEN band < 3 THEN 'ZSTD' ELSE 'SNAPPY' END FROM groups)"


def file_facts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.file_facts(_chunks(X.groups(spark, d)))


FILE_FACTS = f"""WITH {_CHUNKS}, per AS (SELECT rg, max(rows) AS rows, sum(nbytes) AS nbytes FROM chunks GROUP BY rg)
    SELECT (SELECT count(*) FROM per) AS row_groups, (SELECT CAST(sum(rows) AS BIGINT) FROM per) AS rows, CAST(sum(nbytes) AS BIGINT) AS nbytes, CASE WHEN count(DISTINCT codec) = 0 THEN 'unknown' WHEN count(DISTINCT codec) = 1 THEN min(codec) ELSE 'mixed' END AS codec, round(sum(3 * nbytes) / CAST(sum(nbytes) AS DOUBLE), 6) AS ratio,
        (SELECT CAST(median(nbytes) AS DOUBLE) FROM per) AS median_bytes, CAST(coalesce(sum(nbytes) FILTER (WHERE col = 'geometry'), 0) AS BIGINT) AS exact_bytes, CAST(coalesce(sum(nbytes) FILTER (WHERE col = 'geom_overview'), 0) AS BIGINT) AS overview_bytes FROM chunks"""


def share_of_file(spark: SparkSession, d: str) -> DataFrame:
    return planner.share_of_file(X.groups(spark, d)).select("rg", F.round("bytes_share", 6).alias("bytes_share"), F.round("rows_share", 6).alias("rows_share"))


SHARE_OF_FILE = f"WITH {X.GROUPS} SELECT rg, round(100 * nbytes / CAST(sum(nbytes) OVER () AS DOUBLE), 6) AS bytes_share, round(100 * rows / CAST(sum(rows) OVER () AS DOUBLE), 6) AS rows_share FROM groups"


def planned_bytes_sweep(spark: SparkSession, d: str) -> DataFrame:
    e = stats.extent(X.points(spark, d))
    info, g, out = X.info(), X.groups(spark, d), None
    chunks = _chunks(g)
    for name, aoi, zoom in planner.viewport_ladder((e.x0, e.y0, e.x1, e.y1)):
        # the frame is no globe: plan without the seam
        level = planner.level_for_zoom(info, zoom)
        hit = g.where((F.col("rg") <= level.row_group_end) & (F.col("bbox").isNull() | C.intersects(F.col("bbox"), aoi)))
        column = F.lit(planner.column_for_level(info, level))
        hit = hit.withColumn("column", F.when(F.col("band") < level.level, F.lit("geometry")).otherwise(column))
        part = planner.planned_bytes(hit, chunks.select("rg", "column", "nbytes")).select(F.lit(name).alias("viewport"), "groups", "planned_bytes")
        out = part if out is None else out.union(part)
    return out


PLANNED_BYTES_SWEEP = f"""WITH {_CHUNKS}, e AS (SELECT min(cx) AS x0, min(cy) AS y0, max(cx) AS x1, max(cy) AS y1 FROM pts),
    v AS (SELECT * FROM (VALUES ('full', 1.0, 0), ('region', 0.125, 1), ('city', 0.015625, 2), ('district', 0.001953125, 3)) AS t(viewport, part, target)),
    box AS (SELECT viewport, target, (x0 + x1) / 2 - (x1 - x0) * CAST(part AS DOUBLE) / 2 AS a, (y0 + y1) / 2 - (y1 - y0) * CAST(part AS DOUBLE) / 2 AS b, (x0 + x1) / 2 + (x1 - x0) * CAST(part AS DOUBLE) / 2 AS c, (y0 + y1) / 2 + (y1 - y0) * CAST(part AS DOUBLE) / 2 AS d FROM v, e),
    plan AS (SELECT viewport, rg, CASE WHEN band < target OR target = 3 THEN 'geometry' ELSE 'geom_overview' END AS col FROM groups, box WHERE band <= target AND (NOT known OR (xmin <= c AND xmax >= a AND ymin <= d AND ymax >= b)))
    SELECT viewport, count(plan.rg) AS groups, CAST(coalesce(sum(nbytes), 0) AS BIGINT) AS planned_bytes FROM v LEFT JOIN plan USING (viewport) LEFT JOIN chunks USING (rg, col) GROUP BY viewport"""


def overfetch_by_zoom(spark: SparkSession, d: str) -> DataFrame:
    return catalog.overfetch(X.points(spark, d), range(0, 16))


OVERFETCH_BY_ZOOM = f"WITH {X.POINTS}, e AS (SELECT count(*) AS n, max(cx) - min(cx) AS w, max(cy) - min(cy) AS h FROM pts) SELECT CAST(z AS INTEGER) AS zoom, round(n / (w * h / pow(360.0 / (256 * pow(2.0, z)), 2)), 9) AS per_pixel FROM e, range(0, 16) AS r(z)"


def version_twin(spark: SparkSession, d: str) -> DataFrame:
    """The same dataset in the versions of a catalogue made of nations (versions are regions)."""
    n = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sets = n.groupBy(F.col("r_name").alias("version")).agg(F.collect_list(F.struct((F.col("n_nationkey") % 7).cast("string").alias("id"), F.col("n_name").alias("label"), F.concat(F.lit("/"), F.col("n_name")).alias("path"))).alias("datasets"))
    doc = sets.agg(F.to_json(F.struct(F.lit("ASIA").alias("latest"), F.lit("base").alias("base"), F.collect_list(F.struct("version", F.lower("version").alias("prefix"), "datasets")).alias("versions"))).alias("text"))
    return catalog.twins(catalog.datasets(doc), "ASIA", "EUROPE")


VERSION_TWIN = """WITH s AS (SELECT r_name AS version, CAST(n_nationkey % 7 AS VARCHAR) AS id, n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT a.id, a.label, b.label AS twin_label FROM s a LEFT JOIN s b ON a.id = b.id AND b.version = 'EUROPE' WHERE a.version = 'ASIA'"""


def density_style(spark: SparkSession, d: str) -> DataFrame:
    c = X.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg((F.count("*") - 1).alias("n"))
    return c.select("id", F.round(C.density_radius(F.col("n")), 6).alias("radius"), F.round(C.density_alpha(F.col("n")), 6).alias("alpha"))


DENSITY_STYLE = "SELECT user_id AS id, round(CASE WHEN count(*) > 1 THEN 2.5 * greatest(1, least(5, 0.6 + 0.5 * log2(count(*) - 1))) ELSE 2.5 END, 6) AS radius, round(CASE WHEN count(*) > 1 THEN greatest(110, least(255, 110 + 36 * log2(count(*) - 1))) ELSE 180 END, 6) AS alpha FROM events GROUP BY 1"


def row_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of picked rows: every fetch of the log names a row; values are shown as text."""
    from geoladder.sources.reader import attribute_columns

    o = X.table(spark, d, "orders").withColumn("geometry", F.lit(b"")).withColumn("band", F.lit(0)).withColumn("row_id", F.col("o_orderkey"))
    keep = [c for c in attribute_columns(o.columns) if c not in ("row_id", "o_orderdate", "o_totalprice")]
    picked = X.table(spark, d, "events").select((F.col("user_id") * 7).alias("row_id")).distinct()
    kinds = dict(o.dtypes)
    return o.join(picked, "row_id", "left_semi").select("row_id", *[C.shown(F.col(c), kinds[c]).alias(c) for c in keep])


ROW_ATTRIBUTES = "SELECT o_orderkey AS row_id, CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(CAST(o_custkey AS VARCHAR), '') AS o_custkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority FROM orders WHERE o_orderkey IN (SELECT user_id * 7 FROM events)"


def clamped_boxes(spark: SparkSession, d: str) -> DataFrame:
    g = X.geo_points(spark, d).withColumn("wide", F.struct((F.col("x") * 1.5).alias("xmin"), (F.col("y") * 2).alias("ymin"), (F.col("x") * 1.5 + 20).alias("xmax"), (F.col("y") * 2 + 5).alias("ymax")))
    return g.withColumn("c", C.clamp_geographic(F.col("wide"))).select("id", *[F.round(f"c.{s}", 9).alias(s) for s in ("xmin", "ymin", "xmax", "ymax")])


def _clamp(lo: str, hi: str, top: int) -> tuple[str, str]:
    a, b = f"greatest(-{top}, least({top}, {lo}))", f"greatest(-{top}, least({top}, {hi}))"
    return f"CASE WHEN {a} < {b} THEN {a} ELSE greatest(-{top}, ({a} + {b}) / 2 - 0.000001) END", f"CASE WHEN {a} < {b} THEN {b} ELSE least({top}, ({a} + {b}) / 2 + 0.000001) END"


_CX, _CY = _clamp("x * 1.5", "x * 1.5 + 20", 180), _clamp("y * 2", "y * 2 + 5", 90)
CLAMPED_BOXES = f"WITH {X.GEO_POINTS} SELECT id, round({_CX[0]}, 9) AS xmin, round({_CY[0]}, 9) AS ymin, round({_CX[1]}, 9) AS xmax, round({_CY[1]}, 9) AS ymax FROM geo"


def columns_and_groups(spark: SparkSession, d: str) -> DataFrame:
    """What plans at three zooms read: their distinct geometry columns, and the groups that are painted."""
    g, out = X.groups(spark, d), None
    info = X.info(_extents(g))
    for zoom in (6, 9, 14):
        plan = planner.plan_overviews(info, g, AOI, zoom)
        part = planner.columns_read(plan).agg(F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns")).crossJoin(planner.groups_painted(plan)).withColumn("zoom", F.lit(zoom))  # a row each
        out = part if out is None else out.unionByName(part)
    return out.select("zoom", "columns", "groups")


COLUMNS_AND_GROUPS = f"""WITH v AS ({VIEWPORT_READ}) SELECT zoom, string_agg(DISTINCT "column", ',' ORDER BY "column") AS columns, count(DISTINCT rg) AS groups FROM v GROUP BY zoom"""


def group_box_order(spark: SparkSession, d: str) -> DataFrame:
    """A group's box from the covering, else from usable statistics of the coarse shapes, else of the exact ones."""
    g = X.groups(spark, d)
    struct = lambda scale, odd: F.struct(*[(F.col(f"bbox.{c}") * scale + (odd if c == "xmin" else 0)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    wild = F.when(F.col("rg") % 3 == 0, float("inf")).otherwise(0.0)
    g = g.withColumn("covering", F.when(F.col("rg") % 4 == 0, F.col("bbox"))).withColumn("coarse", struct(2, wild)).withColumn("exact", struct(3, F.lit(0.0)))
    g = g.withColumn("box", planner.group_box(F.col("covering"), F.col("coarse"), F.col("exact")))
    return g.select("rg", *[F.round(f"box.{c}", 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


GROUP_BOX_ORDER = f"WITH {X.GROUPS}, f AS (SELECT *, CASE WHEN rg % 4 = 0 THEN 1 WHEN rg % 3 <> 0 THEN 2 ELSE 3 END AS k FROM groups) SELECT rg, " + ", ".join(f"CASE WHEN known THEN round(k * {c}, 6) END AS {c}" for c in ("xmin", "ymin", "xmax", "ymax")) + " FROM f"


def uncached_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The parts of wanted row ranges that no cached range covers, each with its group's column."""
    p = kept(X.pages(spark, d), "pages")
    want = p.where("page % 3 <> 2").withColumn("column", F.when(F.col("rg") % 2 == 0, "geometry").otherwise("geom_overview")).select("rg", "column", "row_start", "row_end")
    held = p.where("page % 2 = 0").withColumn("column", F.lit("geometry")).select("rg", "column", (F.col("row_start") + 10).alias("row_start"), "row_end")
    return planner.uncached_ranges(want, held)


UNCACHED_RANGES = f"""WITH {X.PAGES}, want AS (SELECT rg, page, CASE WHEN rg % 2 = 0 THEN 'geometry' ELSE 'geom_overview' END AS col, row_start, row_end FROM page_t WHERE page % 3 <> 2)
    SELECT rg, col AS "column", row_start, CASE WHEN col = 'geometry' AND page % 2 = 0 THEN least(row_start + 10, row_end) ELSE row_end END AS row_end FROM want"""


def chunk_bytes(spark: SparkSession, d: str) -> DataFrame:
    return planner.chunk_bytes(_chunks(X.groups(spark, d)), "geom_overview")


CHUNK_BYTES = f"WITH {_CHUNKS} SELECT rg, CAST(sum(nbytes) AS BIGINT) AS nbytes FROM chunks WHERE col = 'geom_overview' GROUP BY rg"


def file_extent(spark: SparkSession, d: str) -> DataFrame:
    return planner.file_extent(X.groups(spark, d)).select("extent.*")


FILE_EXTENT = f"WITH {X.GROUPS} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM groups WHERE known"


def vertex_styles(spark: SparkSession, d: str) -> DataFrame:
    """A row's radius and opacity at each vertex of its pieces, added up by kind of piece."""
    from geoladder.functions import udfs

    s = X.segments(spark, d).select("id", udfs.segment_wkb("xmin", "ymin", "xmax", "ymax").alias("g"))
    p = X.points(spark, d).select((F.col("id") + 10**9).alias("id"), udfs.point_wkb("xmin", "ymin").alias("g"))
    pieces = s.union(p).select("id", F.explode(udfs.primitives("g")).alias("p")).select("id", "p.kind", "p.coords")
    counts = s.union(p).select("id", (F.col("id") % 9).cast("int").alias("count"))
    styled = planner.vertex_styles(pieces, counts, "id")
    return styled.groupBy("kind").agg(F.sum(F.size("radius")).alias("vertices"), F.round(F.sum(F.aggregate("radius", F.lit(0.0), lambda a, x: a + x)), 3).alias("radius"), F.round(F.sum(F.aggregate("alpha", F.lit(0.0), lambda a, x: a + x)), 3).alias("alpha"))


_STYLE = "2.5 * CASE WHEN n > 0 THEN greatest(1, least(5, 0.6 + 0.5 * log2(n))) ELSE 1 END AS radius, CASE WHEN n > 0 THEN greatest(110, least(255, 110 + 36 * log2(n))) ELSE 180 END AS alpha"
VERTEX_STYLES = f"WITH s AS (SELECT 'paths' AS kind, 2 AS v, event_id % 9 AS n FROM events UNION ALL SELECT 'points', 1, (o_orderkey + 1000000000) % 9 FROM orders), t AS (SELECT kind, v, {_STYLE} FROM s) SELECT kind, CAST(sum(v) AS BIGINT) AS vertices, round(sum(v * radius), 3) AS radius, round(sum(v * alpha), 3) AS alpha FROM t GROUP BY kind"


def _layout(spark: SparkSession, d: str, name: str) -> str:
    """A written layout of the squares, with attributes."""
    import uuid

    from geoladder.convert import convert
    from geoladder.functions import udfs
    from geoladder.options import LayoutOptions

    target = f"{work_root(spark)}/geoladder/{name}-{uuid.uuid4().hex}"
    src = X.boxes(spark, d).select("id", (F.col("id") * 3).alias("weight"), udfs.box_wkb("xmin", "ymin", "xmax", "ymax").alias("geometry"))
    convert(spark, src, target, LayoutOptions(bands=X.BANDS, native_geo=False, coarsest_rel=1 / 20, bbox="always"))
    return target


def layout_viewport(spark: SparkSession, d: str) -> DataFrame:
    """A conversion, written and read through ``Layout.viewport`` far in: the exact shapes that may meet the viewport."""
    from geoladder.functions import udfs
    from geoladder.sources.reader import read_layout

    shapes = read_layout(spark, _layout(spark, d, "viewport")).viewport((20.0, 0.0, 60.0, 3.0), 24, ["id"])
    m = shapes.withColumn("m", udfs.measures("shape"))
    return m.where(C.intersects(F.struct("m.xmin", "m.ymin", "m.xmax", "m.ymax"), (20.0, 0.0, 60.0, 3.0))).select("id", *[F.round(f"m.{c}", 9).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


LAYOUT_VIEWPORT = f"WITH {X.BOXES} SELECT id, round(xmin, 9) AS xmin, round(ymin, 9) AS ymin, round(xmax, 9) AS xmax, round(ymax, 9) AS ymax FROM boxes WHERE xmin <= 60 AND xmax >= 20 AND ymin <= 3 AND ymax >= 0"


def layout_row(spark: SparkSession, d: str) -> DataFrame:
    """The attributes of picked features through ``Layout.row``."""
    from geoladder.sources.reader import read_layout

    layout = read_layout(spark, _layout(spark, d, "row"))
    return layout.row("id", 17).unionByName(layout.row("id", 170)).unionByName(layout.row("id", -1)).select("id", "weight")


LAYOUT_ROW = "SELECT p_partkey AS id, 3 * p_partkey AS weight FROM part WHERE p_partkey IN (17, 170)"


def file_groups(spark: SparkSession, d: str) -> DataFrame:
    """The single-file export, opened by its footers alone: row groups with bands, boxes from the covering's statistics and
    bytes; then planned, priced, and scanned by rows with their numbers in the file."""
    from geoladder.sources import reader, writer

    target = _layout(spark, d, "export")
    one = reader.read_file(spark, writer.export_file(spark, target, f"{target}.parquet"))
    plan = planner.plan(one.info, one.groups, (20.0, 0.0, 60.0, 3.0), 24)
    priced = planner.planned_bytes(plan.groups, one.chunks.where("nbytes > 0").select("rg", "column", "nbytes")).first()
    levels = len(one.info.levels)
    sizes = [planner.prefix_bytes(one.info, k) for k in range(levels)]
    ranges = plan.groups.select("rg", "row_start", "row_end")
    rows = one.scan(["id"], ranges)
    every = one.groups.agg(F.sum("rows").alias("rows"), F.count_if(F.col("bbox").isNull()).alias("unknown")).first()
    facts = [every.rows, every.unknown, rows.select("row_index").distinct().count() - plan.groups.agg(F.sum("rows")).first()[0], int(priced.planned_bytes > 0), int(all(a and a[0] < a[1] for a in sizes)), rows.where("id is null").count()]
    return spark.createDataFrame([facts], "rows long, without_box long, rows_amiss long, priced long, prefixes long, nulls long")


FILE_GROUPS = "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS without_box, CAST(0 AS BIGINT) AS rows_amiss, CAST(1 AS BIGINT) AS priced, CAST(1 AS BIGINT) AS prefixes, CAST(0 AS BIGINT) AS nulls FROM part"


FUNCTIONS = [columns_and_groups, group_box_order, uncached_ranges, chunk_bytes, file_extent, vertex_styles, layout_viewport, layout_row, file_groups, level_for_zoom, rowgroup_prune, seam_split_prune, band_skip, viewport_read, flat_preview_boxes, page_ranges_merged, page_pairing, page_gate, count_lookup, cache_hits_misses, plan_signature, byte_meter, recent_events, stream_meter, prune_outcomes, file_facts, share_of_file, planned_bytes_sweep, overfetch_by_zoom, version_twin, density_style, row_attributes, clamped_boxes]
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLE_SQL = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
