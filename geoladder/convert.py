"""From a table of geometries to a layout.

1. measure: one pass over the geometries (bounds, area, length, representative point), written once;
2. a one-row aggregate gives the extent, one of 128 x 128 cells the density, and so the number of bands;
3. rank, thin band 0, cut the rest into bands; number the bands that have rows;
4. curve order, row groups, coarse shapes, padded boxes;
5. write rows, row groups and footers.
"""

from __future__ import annotations

import uuid
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoladder.functions import columns as C
from geoladder.functions import udfs
from geoladder.operators import banding, levels, rowgroups, stats
from geoladder.options import MEGABYTE, RESERVED, LayoutOptions
from geoladder.plans import footer, ladder
from geoladder.sources import reader, writer

#: Row groups' bytes in a range of the curve within which the exact band's row groups are cut in one task.
RANGE_GROUPS = 16
#: Rows in a file of measures at most.
FILE_ROWS = 200_000


def measure(rows: DataFrame, geometry: str, options: LayoutOptions) -> DataFrame:
    """The rows with their measures: bounds, cx, cy, area, length, dim, valid, gtype, rx, ry, nbytes, hash, row_id."""
    keep = [c for c in rows.columns if c != geometry and c not in RESERVED]
    if options.importance_column is not None:
        if options.importance_column not in rows.columns:
            raise ValueError(f"--importance-column {options.importance_column!r} not found in the input")
        kind = dict(rows.dtypes)[options.importance_column]
        if not kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")):
            raise ValueError(f"--importance-column {options.importance_column!r} must be numeric")
    df = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{geometry}`").cast("binary").alias("geometry"))
    df = df.withColumn("row_id", F.monotonically_increasing_id()).withColumn("m", udfs.measures("geometry"))
    names = ["xmin", "ymin", "xmax", "ymax", "area", "length", "dim", "valid", "gtype", "rx", "ry"]
    df = df.select("*", *[F.col(f"m.{n}").alias(n) for n in names]).drop("m")
    return df.withColumn("cx", (F.col("xmin") + F.col("xmax")) / 2).withColumn("cy", (F.col("ymin") + F.col("ymax")) / 2).withColumn("nbytes", F.coalesce(F.octet_length("geometry"), F.lit(0)).cast("bigint")).withColumn("hash", F.coalesce(F.crc32("geometry"), F.lit(0)))


_MEASURES = ["row_id", "xmin", "ymin", "xmax", "ymax", "area", "length", "dim", "valid", "gtype", "rx", "ry", "cx", "cy", "nbytes", "hash", "score"]


def convert(spark: SparkSession, source: str | DataFrame, target: str, options: LayoutOptions | None = None) -> dict[str, Any]:
    """Writes the layout of a table to a directory and returns a summary."""
    options = (options or LayoutOptions()).validate()
    src = reader.Source(source, "geometry", {}, {}) if isinstance(source, DataFrame) else reader.read_features(spark, source)
    if src.rows.isEmpty():
        raise ValueError("the input has no rows")
    work = f"{target.rstrip('/')}-work-{uuid.uuid4().hex}"
    # in files of so many rows that the tasks which read them are many, however few those of the input are
    measure(src.rows, src.geometry, options).write.option("maxRecordsPerFile", FILE_ROWS).parquet(work)
    measured = spark.read.parquet(work)
    try:
        return _layout(spark, measured, src, target, options)
    finally:
        fs, path = reader.open_path(work)
        fs.delete_dir(path)


def _layout(spark: SparkSession, measured: DataFrame, src: reader.Source, target: str, options: LayoutOptions) -> dict[str, Any]:
    e = stats.extent(measured)
    world = ladder.world_width(src.geographic)
    density = stats.density_quantile(stats.density_histogram(measured, e), e).first().density
    wanted = options.bands or ladder.derive_bands(density, e.span, options.coarsest_rel, options.ladder_factor, options.screen_budget_mb * MEGABYTE)
    bands = ladder.clamp_bands(wanted, e.span_x, e.span_y, world)
    label = ladder.regime(e.total_bytes, e.n_valid)
    with_bbox = ladder.wants_bbox(options.bbox, label, options.native_geo)
    dims = {r.dim for r in measured.where("valid").select("dim").distinct().collect()}
    scored, importance = banding.rank_metric(measured, dims, src.geographic, options.importance_column)
    marked = f"{target.rstrip('/')}-marked-{uuid.uuid4().hex}"
    # slim rows are ranked, and their bands join the rows once
    assigned = banding.assign(scored, bands, e, options.thin, options.coarsest_rel, options.ladder_factor, options.band_fractions, [F.col("hash"), F.col("row_id")], path=marked)
    present = assigned.groupBy("band").count().collect()  # ten rows at most
    rows = measured.join(assigned.withColumnRenamed("row_id", "__row"), F.col("row_id") == F.col("__row")).drop("__row")
    bands = len(present)
    last = bands - 1
    tols = ladder.tolerances(bands, e.span, options.coarsest_rel, options.ladder_factor)
    grids = ladder.grids(tols, options.overview_grid)
    has_overview = bands > 1 and dims != {0}
    method = "none" if bands == 1 else "simplify_snap" if has_overview else "thin"
    counted = options.thin and bands > 1

    rows = rows.withColumn("hilbert", C.hilbert(C.quantise(F.col("cx"), e.x0, e.span_x), C.quantise(F.col("cy"), e.y0, e.span_y)))
    if has_overview:
        pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("band") + 1)
        coarse = (F.col("band") < last) & F.col("valid")
        rows = rows.withColumn("geom_overview", udfs.overview(F.col("geometry"), F.when(coarse, pick([*tols, 0.0])), F.when(coarse, pick([*grids, 0.0]))))
    pad = rowgroups.padding(F.col("band"), rowgroups.pads(tols, grids, has_overview))
    box = C.bbox_struct(F.col("xmin") - pad, F.col("ymin") - pad, F.col("xmax") + pad, F.col("ymax") + pad)
    rows = rows.withColumn("bbox", F.when(F.col("valid"), box))
    if counted:
        keep = (F.col("band") < last) & F.col("valid") & (F.col("overview_count") > 0)
        rows = rows.withColumn("overview_count", F.when(keep, F.col("overview_count").cast("int")))
    else:
        rows = rows.drop("overview_count")
    rows = rows.drop("cx", "cy", "rx", "ry", "hash", "area", "length", "xmin", "ymin", "xmax", "ymax")

    # from here on everything reads the banded rows from a table: ranks and coarse shapes are made once
    banded = f"{target.rstrip('/')}-banded-{uuid.uuid4().hex}"
    rows.write.partitionBy("band").parquet(banded)
    rows = spark.read.parquet(banded).withColumn("band", F.col("band").cast("int"))
    fs, path = reader.open_path(marked)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)

    # row groups: equal parts of the coarse bands, byte budgets in ranges of the curve for the exact one
    sizes = {r.band: r["count"] for r in present}
    parts = []
    for b in range(last):
        # slim rows are numbered, and the group joins them again
        place = banding.numbered(rows.where(F.col("band") == b).select("hilbert", F.col("row_id").alias("__row")), [("hilbert", False), ("__row", False)], "__place", sizes[b])
        plan = place.select("__row", rowgroups.group_of_place(F.col("__place"), sizes[b], options.coarse_row_groups).alias("rg"))
        parts.append(rows.where(F.col("band") == b).withColumn("__range", F.lit(0)).join(plan, F.col("row_id") == F.col("__row")).drop("__row"))
    budget = int(options.row_group_mb * MEGABYTE)
    n_ranges = max(1, -(-e.total_bytes // (budget * RANGE_GROUPS)))
    exact = rows.where(F.col("band") == last)
    slim = exact.select(F.col("row_id").alias("__row"), "hilbert", "nbytes")
    if n_ranges > 1:
        # by places, so that shapes at one place of the curve do not meet in one range
        slim = banding.numbered(slim, [("hilbert", False), ("__row", False)], "__place", sizes[last]).withColumn("__range", F.floor(F.col("__place") * n_ranges / sizes[last]).cast("int"))
    else:
        slim = slim.withColumn("__range", F.lit(0))
    plan = rowgroups.greedy_groups(slim.select("__row", "hilbert", "nbytes", "__range"), ["hilbert", "__row"], "nbytes", budget, by="__range").select("__row", "__range", "rg")
    parts.append(exact.join(plan, F.col("row_id") == F.col("__row")).drop("__row"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    staged = f"{target.rstrip('/')}-staged-{uuid.uuid4().hex}"
    out.write.parquet(staged)
    out = spark.read.parquet(staged)
    fs, path = reader.open_path(banded)
    fs.delete_dir(path)
    try:
        from pyspark.sql import Window

        present_groups = out.select("band", "__range", "rg").distinct().withColumn("__n", (F.row_number().over(Window.orderBy("band", "__range", "rg")) - 1).cast("int"))
        named = present_groups.select(F.col("band").alias("__band"), F.col("__range").alias("__r"), F.col("rg").alias("__g"), "__n")
        out = out.join(F.broadcast(named), (F.col("band") == F.col("__band")) & (F.col("__range") == F.col("__r")) & (F.col("rg") == F.col("__g"))).withColumn("rg", F.col("__n")).drop("__band", "__r", "__g", "__n", "__range")  # a row per row group
        groups = rowgroups.group_bounds(out, ["band", "rg"])
        total = groups.agg(F.sum("rows").alias("rows"), F.count("*").alias("n")).first()
        if total.rows != e.n_valid + e.n_missing:
            raise ArithmeticError("the row groups do not cover all rows")
        found = levels.level_frame(out).orderBy("level").collect()
        records = levels.level_records(found, tols, grids, world)
        overview_bytes = out.groupBy("band").agg(F.sum(F.octet_length("geom_overview")).alias("o")).collect() if has_overview else []
        shapes = {r.band: r.o or 0 for r in overview_bytes}
        types = sorted(r.gtype for r in out.where("gtype is not null").select("gtype").distinct().collect())
        coarse_types = sorted(r.t for r in out.select(C.type_name(F.col("geom_overview")).alias("t")).where("t is not null").distinct().collect()) if has_overview else None
        keep = [c for c in out.columns if c not in ("dim", "valid", "gtype", "nbytes", "geometry", "bbox", "band", "rg", "geom_overview", "overview_count", "hilbert", "row_id")]
        final = [*keep, "geometry", *(["bbox"] if with_bbox else []), F.col("band").cast("smallint").alias("band"), "rg", *(["geom_overview"] if has_overview else []), *(["overview_count"] if counted else []), "hilbert", "row_id"]
        meta = {k: v for k, v in src.footer.items() if k not in ("geo", "overviews") and not k.startswith(("ARROW:", "org.apache.spark"))}
        crs_value = src.meta["crs"] if "crs" in src.meta else footer.ABSENT
        meta["geo"] = footer.geo_block((e.x0, e.y0, e.x1, e.y1), types, src.meta, crs_value, coarse_types, with_bbox)
        meta["overviews"] = footer.overviews_block(records, importance, method, label, has_overview, with_bbox, "overview_count" if counted else None)
        writer.write_layout(out.select(*final), groups, meta, target, options)
    finally:
        fs, path = reader.open_path(staged)
        fs.delete_dir(path)
    for r, f in zip(records, found, strict=True):
        r["exact_bytes"], r["overview_bytes"] = int(f.nbytes), int(shapes.get(r["level"], 0))
    return {"features": total.rows, "row_groups": total.n, "bands": bands, "regime": label, "bbox": with_bbox, "has_overview": has_overview, "crs_preserved": "crs" in src.meta, "geographic": src.geographic, "importance": importance, "overview_method": method, "levels": records}
