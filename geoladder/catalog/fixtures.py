"""Geometry derived from the driver's tables, as measured rows and as SQL common table expressions.

Measured rows have what the operators need: id, row_id, dim, valid, box, area, length, rx, ry, cx, cy, nbytes, hash.
The hash is md5 here, since the SQL engine has no crc32; it is only a tie break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoladder.plans.footer import LevelInfo, OverviewsInfo

BANDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _measured(df: DataFrame, dim: int, x0: Column, y0: Column, x1: Column, y1: Column, area: Column, length: Column, nbytes: Column, *extra: Column) -> DataFrame:
    d = df.select("id", F.lit(dim).alias("dim"), F.lit(True).alias("valid"), x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"), area.alias("area"), length.alias("length"), nbytes.cast("bigint").alias("nbytes"), *extra)
    d = d.withColumn("cx", (F.col("xmin") + F.col("xmax")) / 2).withColumn("cy", (F.col("ymin") + F.col("ymax")) / 2)
    d = d.withColumn("rx", F.col("cx")).withColumn("ry", F.col("cy")).withColumn("row_id", F.col("id")).withColumn("hash", F.md5(F.col("id").cast("string")))
    return d.withColumn("bbox", F.struct("xmin", "ymin", "xmax", "ymax"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points: customer by price."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    zero = F.lit(0.0)
    return _measured(o, 0, F.col("x"), F.col("y"), F.col("x"), F.col("y"), zero, zero, F.lit(21), F.col("y").alias("metric"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as squares on a lattice, sized by p_size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).cast("double").alias("x"), F.floor(F.col("p_partkey") / 100).cast("double").alias("y"), (F.col("p_size") / F.lit(100.0)).alias("h"))
    x, y, h = F.col("x"), F.col("y"), F.col("h")
    return _measured(p, 2, x - h, y - h, x + h, y + h, (2 * h) * (2 * h), 8 * h, F.lit(93), x.alias("x"), y.alias("y"), h.alias("h"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as line segments of width 1."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), (F.col("event_id") % 7).cast("double").alias("d"))
    x, y, d = F.col("x"), F.col("y"), F.col("d")
    return _measured(e, 1, x, y, x + 1, y + d, F.lit(0.0), F.sqrt(1 + d * d), F.lit(41), x.alias("x"), y.alias("y"), d.alias("d"))


def vertex_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as boxes with a varying number of vertices."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).cast("double").alias("x"), F.floor(F.col("c_custkey") / 50).cast("double").alias("y"), (93 + 16 * (F.col("c_custkey") % 40)).alias("n"))
    x, y = F.col("x"), F.col("y")
    return _measured(c, 2, x, y, x + 1, y + 1, F.lit(1.0), F.lit(4.0), F.col("n"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, squares and segments in one frame of 100 by 20."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).cast("double").alias("x"), (F.col("o_orderkey") % 20).cast("double").alias("y"))
    zero = F.lit(0.0)
    p = _measured(o, 0, F.col("x"), F.col("y"), F.col("x"), F.col("y"), zero, zero, F.lit(21))
    b = table(spark, sf_dir, "part").select((F.col("p_partkey") + 10**9).alias("id"), (F.col("p_partkey") % 100).cast("double").alias("x"), (F.floor(F.col("p_partkey") / 100) % 20).cast("double").alias("y"), (F.col("p_size") / F.lit(100.0)).alias("h"))
    x, y, h = F.col("x"), F.col("y"), F.col("h")
    q = _measured(b, 2, x - h, y - h, x + h, y + h, (2 * h) * (2 * h), 8 * h, F.lit(93))
    e = table(spark, sf_dir, "events").select((F.col("event_id") + 2 * 10**9).alias("id"), (F.col("user_id") % 100).cast("double").alias("x"), (F.col("event_id") % 20).cast("double").alias("y"), (F.col("event_id") % 7).cast("double").alias("d"))
    s = _measured(e, 1, x, y, x + 1, y + F.col("d"), zero, F.sqrt(1 + F.col("d") * F.col("d")), F.lit(41))
    return p.unionByName(q).unionByName(s)


def with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares, every 97th without a geometry."""
    b = boxes(spark, sf_dir).drop("x", "y", "h", "bbox")
    gone = F.col("id") % 97 == 0
    for c in ("xmin", "ymin", "xmax", "ymax", "cx", "cy", "rx", "ry"):
        b = b.withColumn(c, F.when(~gone, F.col(c)))
    b = b.withColumn("valid", ~gone).withColumn("dim", F.when(gone, -1).otherwise(F.col("dim"))).withColumn("area", F.when(gone, 0.0).otherwise(F.col("area"))).withColumn("nbytes", F.when(gone, 0).otherwise(F.col("nbytes")).cast("bigint"))
    return b.withColumn("bbox", F.when(~gone, F.struct("xmin", "ymin", "xmax", "ymax")))


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on the globe."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37 % 3600) / F.lit(10.0) - 180).alias("x"), (F.col("c_acctbal") % 90).alias("y"))
    return c.withColumn("bbox", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")))


#: Row groups of the points at most.
MOST_GROUPS = 32


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points in order of place with their row group and row number."""
    from geoladder.operators.banding import numbered
    from geoladder.operators.rowgroups import group_of_place

    p = points(spark, sf_dir)
    n = p.count()
    placed = numbered(p, [("cx", False), ("cy", False), ("id", False)], "row_index", n).withColumn("row_index", F.col("row_index").cast("bigint"))
    return placed.withColumn("rg", group_of_place(F.col("row_index"), n, MOST_GROUPS))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row group: rg, rows, nbytes, bbox (unknown for every fifth), row_start, row_end, band.

    They are made once and kept by the driver, 32 rows at most.
    """
    from geoladder.operators import rowgroups
    from geoladder.plans import planner

    g = rowgroups.row_offsets(rowgroups.group_bounds(grouped(spark, sf_dir), ["rg"]))
    g = planner.stamp_bands(g.withColumn("bbox", F.when(F.col("rg") % 5 != 3, F.col("bbox"))), levels(spark))
    return spark.createDataFrame(g.collect(), g.schema)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 100 rows of each row group: rg, page, row_start, row_end, bbox."""
    from geoladder.operators.rowgroups import start_of_group

    first = start_of_group(F.col("rg"), table(spark, sf_dir, "orders").count(), MOST_GROUPS)
    g = grouped(spark, sf_dir).withColumn("page", F.floor((F.col("row_index") - first) / 100).cast("int"))
    box = F.struct(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    return g.groupBy("rg", "page").agg(F.min("row_index").alias("row_start"), (F.max("row_index") + 1).alias("row_end"), box.alias("bbox"))


#: level, row_group_end, max_zoom of the ladder that the planning queries use.
LEVELS = [(0, 1, 8), (1, 4, 10), (2, 8, 12), (3, 10**6, 24)]


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level int, row_group_end int, max_zoom int")


def info(extents: dict[int, tuple] | None = None) -> OverviewsInfo:
    out = [LevelInfo(a, 0, e, 0, z, 0.0, None, None, (extents or {}).get(a)) for a, e, z in LEVELS]
    return OverviewsInfo("0.3.0", "banded", "hilbert", "geom_overview", "thin", "grid_thin", "overview_count", out)


# ---------------------------------------------------------------------------------------------------------- the same in SQL

_MEASURED = "id, dim, true AS valid, xmin, ymin, xmax, ymax, area, length, CAST(nbytes AS BIGINT) AS nbytes, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, md5(CAST(id AS VARCHAR)) AS hash"
POINTS = f"pts AS (SELECT {_MEASURED}, metric FROM (SELECT o_orderkey AS id, 0 AS dim, CAST(o_custkey AS DOUBLE) AS xmin, o_totalprice AS ymin, CAST(o_custkey AS DOUBLE) AS xmax, o_totalprice AS ymax, CAST(0 AS DOUBLE) AS area, CAST(0 AS DOUBLE) AS length, 21 AS nbytes, o_totalprice AS metric FROM orders))"
BOXES = f"boxes AS (SELECT {_MEASURED}, x, y, h FROM (SELECT *, 2 AS dim, x - h AS xmin, y - h AS ymin, x + h AS xmax, y + h AS ymax, (2 * h) * (2 * h) AS area, 8 * h AS length, 93 AS nbytes FROM (SELECT p_partkey AS id, CAST(p_partkey % 100 AS DOUBLE) AS x, floor(p_partkey / 100.0) AS y, p_size / CAST(100 AS DOUBLE) AS h FROM part)))"
SEGMENTS = f"segs AS (SELECT {_MEASURED}, x, y, d FROM (SELECT *, 1 AS dim, x AS xmin, y AS ymin, x + 1 AS xmax, y + d AS ymax, CAST(0 AS DOUBLE) AS area, sqrt(1 + d * d) AS length, 41 AS nbytes FROM (SELECT event_id AS id, CAST(user_id AS DOUBLE) AS x, value AS y, CAST(event_id % 7 AS DOUBLE) AS d FROM events)))"
VERTEX_BOXES = f"vboxes AS (SELECT {_MEASURED} FROM (SELECT *, 2 AS dim, x AS xmin, y AS ymin, x + 1 AS xmax, y + 1 AS ymax, CAST(1 AS DOUBLE) AS area, CAST(4 AS DOUBLE) AS length, n AS nbytes FROM (SELECT c_custkey AS id, CAST(c_custkey % 50 AS DOUBLE) AS x, floor(c_custkey / 50.0) AS y, 93 + 16 * (c_custkey % 40) AS n FROM customer)))"
MIXED = f"""mixed AS (SELECT {_MEASURED} FROM (
    SELECT o_orderkey AS id, 0 AS dim, CAST(o_custkey % 100 AS DOUBLE) AS xmin, CAST(o_orderkey % 20 AS DOUBLE) AS ymin, CAST(o_custkey % 100 AS DOUBLE) AS xmax, CAST(o_orderkey % 20 AS DOUBLE) AS ymax, CAST(0 AS DOUBLE) AS area, CAST(0 AS DOUBLE) AS length, 21 AS nbytes FROM orders
    UNION ALL SELECT id, 2, x - h, y - h, x + h, y + h, (2 * h) * (2 * h), 8 * h, 93 FROM (SELECT p_partkey + 1000000000 AS id, CAST(p_partkey % 100 AS DOUBLE) AS x, CAST(CAST(floor(p_partkey / 100.0) AS BIGINT) % 20 AS DOUBLE) AS y, p_size / CAST(100 AS DOUBLE) AS h FROM part)
    UNION ALL SELECT id, 1, x, y, x + 1, y + d, CAST(0 AS DOUBLE), sqrt(1 + d * d), 41 FROM (SELECT event_id + 2000000000 AS id, CAST(user_id % 100 AS DOUBLE) AS x, CAST(event_id % 20 AS DOUBLE) AS y, CAST(event_id % 7 AS DOUBLE) AS d FROM events)))"""
GEO_POINTS = "geo AS (SELECT c_custkey AS id, (c_custkey * 37 % 3600) / CAST(10 AS DOUBLE) - 180 AS x, c_acctbal % 90 AS y FROM customer)"
GROUPED = f"""{POINTS}, numbered AS (SELECT *, row_number() OVER (ORDER BY cx, cy, id) - 1 AS row_index, count(*) OVER () AS n FROM pts),
    shaped AS (SELECT *, n // k AS q, n % k AS r FROM (SELECT *, least(32, greatest(1, n // 1024)) AS k FROM numbered)),
    grouped AS (SELECT *, CAST(CASE WHEN row_index < r * (q + 1) THEN row_index // (q + 1) ELSE r + (row_index - r * (q + 1)) // q END AS INTEGER) AS rg FROM shaped)"""
GROUPS = f"""{GROUPED}, bounds AS (SELECT rg, count(*) AS rows, sum(nbytes) AS nbytes, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, min(row_index) AS row_start, max(row_index) + 1 AS row_end FROM grouped GROUP BY rg),
    groups AS (SELECT rg, rows, nbytes, row_start, row_end, rg % 5 <> 3 AS known, xmin, ymin, xmax, ymax, CAST(CASE WHEN rg <= 1 THEN 0 WHEN rg <= 4 THEN 1 WHEN rg <= 8 THEN 2 ELSE 3 END AS INTEGER) AS band FROM bounds)"""
PAGES = f"""{GROUPED}, paged AS (SELECT *, CAST((row_index - min(row_index) OVER (PARTITION BY rg)) // 100 AS INTEGER) AS page FROM grouped),
    page_t AS (SELECT rg, page, min(row_index) AS row_start, max(row_index) + 1 AS row_end, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM paged GROUP BY rg, page)"""
