"""Viewport planning: which level, which row groups, which pages, which geometry column.

The planner works on small tables (a row per level, row group or page) and answers with DataFrames; what it decides
turns into partition filters and pushed-down predicates of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoladder.functions import columns as C
from geoladder.plans.footer import LevelInfo, OverviewsInfo

PREVIEW_MAX_ZOOM = 11
PAGE_GATE = 1.5
MOST_INDEX_BYTES = 16 << 20


def level_for_zoom(info: OverviewsInfo, zoom: float) -> LevelInfo:
    """The first level that still serves the zoom, else the last."""
    return next((v for v in info.levels if zoom <= v.max_zoom), info.levels[-1])


def level_for_zoom_frame(levels: DataFrame, zooms: DataFrame) -> DataFrame:
    """zoom, level for a table of zooms and one of levels (level, max_zoom)."""
    last = levels.agg(F.max("level").alias("last"))
    hit = zooms.join(F.broadcast(levels), F.col("zoom") <= F.col("max_zoom"), "left").groupBy("zoom").agg(F.min("level").alias("level"))  # a row per level
    return hit.join(F.broadcast(last)).select("zoom", F.coalesce("level", "last").alias("level"))


def column_for_level(info: OverviewsInfo, level: LevelInfo) -> str:
    return info.overview_column if info.overview_column and level.level < info.levels[-1].level else "geometry"


def column_for_group(info: OverviewsInfo, level: LevelInfo, band: int | None) -> str:
    """Coarser bands of a prefix are read exactly where each band has a grid of its own: their shapes are too coarse here."""
    if info.mode == "banded" and info.own_grids and band is not None and band < level.level:
        return "geometry"
    return column_for_level(info, level)


def bands_outside(info: OverviewsInfo, aoi: C.Box) -> set[int]:
    """Bands whose known extent misses the viewport; an unknown extent is never skipped."""
    parts = C.split_at_seam(aoi)
    meets = lambda e: any(e[0] <= p[2] and e[2] >= p[0] and e[1] <= p[3] and e[3] >= p[1] for p in parts)
    return {v.level for v in info.levels if v.extent and not meets(v.extent)}


def stamp_bands(groups: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds to each row group (rg) the first level whose prefix reaches it; null beyond the last."""
    ends = levels.select(F.col("level").alias("__level"), F.col("row_group_end").alias("__end"))
    near = groups.join(F.broadcast(ends), F.col("rg") <= F.col("__end"), "left")  # a row per level
    return near.groupBy(*groups.columns).agg(F.min("__level").cast("int").alias("band"))


@dataclass
class ReadPlan:
    """Row groups (rg, band, column) to read, and what identifies the plan."""

    groups: DataFrame
    column: str
    lod_key: str
    band: int | None
    preview: bool = False


def plan_overviews(info: OverviewsInfo, groups: DataFrame, aoi: C.Box, zoom: float) -> ReadPlan:
    """Groups of the level's prefix (or slice) that may meet the viewport. ``groups``: rg, band, bbox."""
    level = level_for_zoom(info, zoom)
    column = column_for_level(info, level)
    skip = sorted(bands_outside(info, aoi))
    hit = groups.where(F.col("rg").between(level.row_group_start, level.row_group_end) & C.keep_unknown(F.col("bbox"), aoi))
    if skip:
        hit = hit.where(F.col("band").isNull() | ~F.col("band").isin(skip))
    chosen = F.lit(column)
    for v in info.levels:
        chosen = F.when(F.col("band") == v.level, F.lit(column_for_group(info, level, v.level))).otherwise(chosen)
    return ReadPlan(hit.withColumn("column", chosen), column, f"L{level.level}:{column}", level.level)


def plan_flat(groups: DataFrame, aoi: C.Box, zoom: float, column: str = "geometry", prunable: bool = True) -> ReadPlan:
    """Without levels: all groups that may meet the viewport; far out their boxes stand for them, if any is known."""
    hit = groups.where(C.keep_unknown(F.col("bbox"), aoi)) if prunable else groups
    hit = hit.withColumn("column", F.lit(column))
    if zoom < PREVIEW_MAX_ZOOM:
        boxes = hit.where("bbox is not null")
        if boxes.limit(1).count():
            return ReadPlan(boxes.withColumn("ring", C.ring(F.col("bbox"))), column, "flat:preview", None, True)
    return ReadPlan(hit, column, "flat:geom", None)


def plan(info: OverviewsInfo | None, groups: DataFrame, aoi: C.Box, zoom: float, column: str = "geometry") -> ReadPlan:
    """The plan of the layout that the footer shows."""
    return plan_overviews(info, groups, aoi, zoom) if info else plan_flat(groups, aoi, zoom, column)


def merge_pages(pages: DataFrame, aoi: C.Box, group: str = "rg") -> DataFrame:
    """rg, row_start, row_end of the runs of pages that meet the viewport; touching pages are one run."""
    hit = pages.where(C.keep_unknown(F.col("bbox"), aoi))
    order = Window.partitionBy(group).orderBy("row_start")
    reach = F.max("row_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = hit.withColumn("__new", F.when(reach.isNull() | (F.col("row_start") > reach), 1).otherwise(0))
    run = marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(group, "__run").agg(F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end")).drop("__run")


def pair_pages(leaves: DataFrame) -> DataFrame:
    """Pages (rg, page, row_start, row_end, bbox) from the four leaves' indexes (rg, leaf, page, row_start, row_end, low, high).

    A group whose leaves differ in pages or boundaries has none; a page without bounds reaches everywhere.
    """
    shape = leaves.groupBy("rg", "page").agg(F.count("*").alias("n"), F.countDistinct("row_start", "row_end").alias("d"))
    bad = shape.groupBy("rg").agg(F.max(F.when((F.col("n") != 4) | (F.col("d") != 1), 1).otherwise(0)).alias("bad")).where("bad = 0").select("rg")
    side = lambda leaf, v, other: F.coalesce(F.max(F.when(F.col("leaf") == leaf, F.col(v))), F.lit(other))
    low, high = float("-inf"), float("inf")
    box = F.struct(side("xmin", "low", low).alias("xmin"), side("ymin", "low", low).alias("ymin"), side("xmax", "high", high).alias("xmax"), side("ymax", "high", high).alias("ymax"))
    return leaves.join(bad, "rg", "left_semi").groupBy("rg", "page").agg(F.min("row_start").alias("row_start"), F.min("row_end").alias("row_end"), box.alias("bbox"))


def page_gate(box: Column, aoi: C.Box) -> Column:
    """Whether a group is large enough against the viewport for its pages to be looked at."""
    area = max(aoi[2] - aoi[0], 0.0) * max(aoi[3] - aoi[1], 0.0)
    return C.box_area(box) >= PAGE_GATE * area


def plan_signature(ranges: DataFrame, column: str) -> DataFrame:
    """One row, signature: the same for plans that read the same rows. ``ranges``: rg, column, sub (null: the whole group)."""
    part = F.concat_ws(":", F.col("rg").cast("string"), F.coalesce("column", F.lit(column)), F.coalesce("sub", F.lit("full")))
    return ranges.agg(F.concat(F.lit(f"{column}|"), F.array_join(F.array_sort(F.collect_list(part)), "|")).alias("signature"))


def key_decimals(zoom: float) -> int:
    import math

    return max(2, min(7, math.floor(zoom / 2 + 0.5)))


def view_key(lod_key: str, aoi: C.Box, zoom: float) -> str:
    """Views with the same key need no new read."""
    d = key_decimals(zoom)
    return f"{lod_key}|" + ",".join(f"{v:.{d}f}" for v in aoi)


def viewport_ladder(extent: C.Box) -> list[tuple[str, C.Box, int]]:
    """Four centred viewports, from the whole extent to a 512th of its sides."""
    cx, cy = (extent[0] + extent[2]) / 2, (extent[1] + extent[3]) / 2
    w, h = extent[2] - extent[0], extent[3] - extent[1]
    box = lambda s: (cx - w * s / 2, cy - h * s / 2, cx + w * s / 2, cy + h * s / 2)
    return [("full", box(1.0), 5), ("region", box(1 / 8), 9), ("city", box(1 / 64), 12), ("district", box(1 / 512), 15)]


def planned_bytes(plan_groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row, groups and planned_bytes: the chunks (rg, column, nbytes) of the planned groups and columns."""
    return plan_groups.select("rg", "column").join(chunks, ["rg", "column"], "left").agg(F.count("*").alias("groups"), F.coalesce(F.sum("nbytes"), F.lit(0)).alias("planned_bytes"))


def prefix_bytes(info: OverviewsInfo, level: int) -> tuple[float, float] | None:
    """Byte range of all row groups up to a level, where the footer carries ranges."""
    first, last = info.levels[0].bytes, info.levels[level].bytes
    return (first[0], last[1]) if first and last else None


def coarse_intervals(chunks: DataFrame, info: OverviewsInfo) -> DataFrame:
    """Byte intervals of the overview chunks of coarse groups. ``chunks``: rg, band, column, start, nbytes."""
    last = info.levels[-1].level
    return chunks.where((F.col("band") < last) & (F.col("column") == (info.overview_column or "")) & (F.col("nbytes") > 0)).select("rg", "start", (F.col("start") + F.col("nbytes")).alias("end"))


def index_region(entries: DataFrame) -> DataFrame:
    """One row, start and end of all page indexes (start, nbytes), or none if they are missing or too far apart."""
    return entries.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("nbytes")).alias("end")).where((F.col("end") - F.col("start")) <= MOST_INDEX_BYTES)


def cache_split(ranges: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges with ``hit``: whether they are in the cache. Each side is looked up by key, nothing is gathered."""
    known = cached.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return ranges.join(known, keys, "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def counts_for_rows(rows: DataFrame, groups: DataFrame, row: str = "row_id") -> DataFrame:
    """Adds ``count`` from the group whose interval [row_start, row_end) holds the row; 0 elsewhere.

    Intervals do not overlap, so the last start at or before the row decides. Rows and starts are merged in one sort per
    range of rows; no row meets more than one interval.
    """
    width = 65536
    g = groups.select(F.col("row_start").alias("__a"), F.col("row_end").alias("__b"), "counts")
    g = g.select("*", F.explode(F.sequence(F.floor(F.col("__a") / width), F.floor((F.greatest("__b", F.col("__a") + 1) - 1) / width))).alias("__slot"))
    # a range of rows takes its own part of the counts
    begin = F.greatest(F.col("__a"), F.col("__slot") * width)
    g = g.select("__slot", "__b", F.slice("counts", (begin - F.col("__a") + 1).cast("int"), F.lit(width)).alias("counts"), begin.alias("__a"))
    near = rows.withColumn("__slot", F.floor(F.col(row) / width))
    hit = near.join(g, (near["__slot"] == g["__slot"]) & (F.col(row) >= F.col("__a")) & (F.col(row) < F.col("__b")), "left")
    at = (F.col(row) - F.col("__a") + 1).cast("int")
    return hit.withColumn("count", F.coalesce(F.when(at <= F.size("counts"), F.element_at("counts", at)), F.lit(0))).select(*[rows[c] for c in rows.columns], "count")


def columns_read(plan: ReadPlan) -> DataFrame:
    """column: the distinct geometry columns of a plan."""
    return plan.groups.select("column").distinct()


def groups_painted(plan: ReadPlan) -> DataFrame:
    """One row, groups: how many distinct row groups a plan reads."""
    return plan.groups.agg(F.countDistinct("rg").alias("groups"))


def usable_stats(box: Column) -> Column:
    """Whether statistics can serve as a box: all four are finite and in order."""
    sides = [box[c] for c in ("xmin", "ymin", "xmax", "ymax")]
    finite = [~F.isnan(s) & (F.abs(s) < float("inf")) for s in sides]
    ok = finite[0] & finite[1] & finite[2] & finite[3] & (sides[0] <= sides[2]) & (sides[1] <= sides[3])
    return F.coalesce(ok, F.lit(False))


def group_box(covering: Column, overview: Column, primary: Column) -> Column:
    """A row group's box: the covering's, else native statistics of the coarse shapes, else of the exact ones, else null."""
    return F.coalesce(covering, F.when(usable_stats(overview), overview), F.when(usable_stats(primary), primary))


def file_extent(groups: DataFrame) -> DataFrame:
    """One row, extent: the union of the known boxes; null without any."""
    box = F.struct(F.min("bbox.xmin").alias("xmin"), F.min("bbox.ymin").alias("ymin"), F.max("bbox.xmax").alias("xmax"), F.max("bbox.ymax").alias("ymax"))
    return groups.agg(F.when(F.count("bbox") > 0, box).alias("extent"))


def prune_outcomes(groups: DataFrame, aoi: C.Box | None) -> DataFrame:
    """outcome, groups, rows: fetched, pruned or no-bbox for a viewport; idle without one."""
    outcome = F.lit("idle") if aoi is None else F.when(F.col("bbox").isNull(), "no-bbox").when(C.meets_aoi(F.col("bbox"), aoi), "fetched").otherwise("pruned")
    return groups.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("groups"), F.sum("rows").alias("rows"))


def share_of_file(groups: DataFrame) -> DataFrame:
    """Adds bytes_share and rows_share, in per cent of all groups."""
    every = groups.agg(F.sum("nbytes").alias("__bytes"), F.sum("rows").alias("__rows"))
    share = groups.join(F.broadcast(every))  # one row
    return share.withColumn("bytes_share", 100 * F.col("nbytes") / F.col("__bytes")).withColumn("rows_share", 100 * F.col("rows") / F.col("__rows")).drop("__bytes", "__rows")


def counted_groups(groups: DataFrame, last: int) -> DataFrame:
    """The groups whose rows can carry density counts: those of bands above the finest."""
    return groups.where(F.col("band") < last)


def chunk_bytes(chunks: DataFrame, column: str) -> DataFrame:
    """rg, nbytes: compressed bytes of a column's chunks (rg, column, nbytes) by row group."""
    return chunks.where(F.col("column") == column).groupBy("rg").agg(F.sum("nbytes").alias("nbytes"))


def uncached_ranges(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """What is left of wanted row ranges (rg, column, row_start, row_end) beside cached ones of the same group and column.

    Cached ranges of a group may touch but not overlap. A range keeps its group's column. Ranges meet by spans of rows, so
    the pairs grow with the ranges and not with the square of those of a group; of the spans that two share, the first counts.
    """
    width = 4096
    first = lambda: F.floor(F.col("row_start") / width)
    spans = F.explode(F.sequence(first(), F.floor((F.greatest("row_end", F.col("row_start") + 1) - 1) / width)))
    key = ["rg", "column", "row_start", "row_end"]
    wanted = wanted.select(*key).distinct()
    w = wanted.select(*key, first().alias("first"), spans.alias("span")).alias("w")
    c = cached.select(*key, first().alias("first"), spans.alias("span")).alias("c")
    on = [F.col(f"w.{k}") == F.col(f"c.{k}") for k in ("rg", "column", "span")] + [F.col("w.span") == F.greatest("w.first", "c.first"), F.col("c.row_start") < F.col("w.row_end"), F.col("c.row_end") > F.col("w.row_start")]
    held = lambda t: F.struct(F.col(f"{t}row_start").alias("a"), F.col(f"{t}row_end").alias("b"))
    met = w.join(c, on).select(*[f"w.{k}" for k in key], held("c.").alias("held"))
    every = met.unionByName(wanted.select(*key, F.when(F.lit(False), held("")).alias("held")))
    w = every.groupBy(*key).agg(F.array_sort(F.collect_list("held")).alias("held"))
    # the gaps before, between and behind the cached ranges
    starts = F.concat(F.array("row_start"), F.transform("held", lambda h: h["b"]))
    ends = F.concat(F.transform("held", lambda h: h["a"]), F.array("row_end"))
    gaps = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: g["a"] < g["b"])
    return w.select("rg", "column", F.explode(gaps).alias("g")).select("rg", "column", F.col("g.a").alias("row_start"), F.col("g.b").alias("row_end"))


def vertex_styles(pieces: DataFrame, counts: DataFrame, row: str) -> DataFrame:
    """Adds radius and alpha to drawable pieces (row, coords): the row's value at each of its vertices."""
    style = counts.select(F.col(row).alias("__row"), C.density_radius(F.col("count")).alias("__radius"), C.density_alpha(F.col("count")).alias("__alpha"))
    n = (F.size("coords") / 2).cast("int")
    styled = pieces.join(style, F.col(row) == F.col("__row"), "left")
    return styled.withColumn("radius", F.array_repeat("__radius", n)).withColumn("alpha", F.array_repeat("__alpha", n)).drop("__row", "__radius", "__alpha")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rg int, column string")
