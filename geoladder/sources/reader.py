"""Reading tables of geometries: plain ones, and written layouts."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from geoladder.functions import columns as C
from geoladder.functions import crs
from geoladder.options import RESERVED
from geoladder.plans import footer, planner

SIDECAR = "_overviews.json"


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def _footer(path: str) -> tuple[dict[str, str], pa.Schema | None]:
    """Key-value metadata and schema of the first Parquet file at a path; nothing where only Spark can open it."""
    try:
        fs, p = open_path(path)
        info = fs.get_file_info(p)
        if info.type == pafs.FileType.Directory:
            files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(p, recursive=True)) if f.path.endswith(".parquet"))
            p = files[0] if files else p
        with fs.open_input_file(p) as f:
            schema = pq.ParquetFile(f).schema_arrow
    except (OSError, pa.ArrowInvalid, IndexError):
        return {}, None
    return {k.decode(): v.decode("utf-8", "replace") for k, v in (schema.metadata or {}).items()}, schema


def _spark_type(t: pa.DataType) -> T.DataType:
    """Native geometry types are read as their bytes, which Spark's own inference refuses."""
    return from_arrow_type(t.storage_type if isinstance(t, pa.BaseExtensionType) else t)


@dataclass
class Source:
    """A table with what its footer says."""

    rows: DataFrame
    geometry: str
    meta: dict[str, Any]
    footer: dict[str, str]

    @property
    def geographic(self) -> bool:
        return crs.is_geographic(self.meta.get("crs"), "crs" in self.meta)


def read_features(spark: SparkSession, path: str) -> Source:
    """Scans a table; the geometry column is the one that the footer names, else ``geometry``."""
    kv, schema = _footer(path)
    reader = spark.read
    if schema is not None and any(isinstance(f.type, pa.BaseExtensionType) or "geoarrow" in str((f.metadata or {}).get(b"ARROW:extension:name", b"")) for f in schema):
        reader = reader.schema(T.StructType([T.StructField(f.name, _spark_type(f.type), True) for f in schema]))
    rows = reader.parquet(path)
    column = footer.geometry_column(rows.columns, kv.get("geo"))
    meta = footer.column_meta(kv.get("geo"), column)
    footer.check_encoding(meta)
    return Source(rows, column, meta, kv)


def attribute_columns(columns: list[str], geometry: str = "geometry") -> list[str]:
    """The columns that are not the layout's own."""
    own = {*RESERVED, geometry, "rg"}
    return [c for c in columns if c not in own]


@dataclass
class Layout:
    """A written layout: its rows, row groups and ladder."""

    path: str
    rows: DataFrame
    groups: DataFrame
    footer: dict[str, Any]

    @property
    def info(self) -> footer.OverviewsInfo | None:
        return footer.parse_overviews(footer.overviews_of(self.footer))

    def viewport(self, aoi: C.Box, zoom: float, attributes: list[str] | None = None) -> DataFrame:
        """The shapes to paint: rows of the level's prefix that meet the viewport, each with the right geometry column.

        Two scans, one of exact and one of coarse shapes, so that each reads one geometry column; bands are partition
        filters and the box is pushed down to row groups and pages.
        """
        info = self.info
        extra = [F.col(c) for c in attributes or []]
        if info is None:
            hit = self.rows.where(C.meets_aoi(F.col("bbox"), aoi)) if "bbox" in self.rows.columns else self.rows
            return hit.select(F.lit(None).cast("int").alias("band"), F.col("geometry").alias("shape"), *extra)
        level = planner.level_for_zoom(info, zoom)
        skip = planner.bands_outside(info, aoi)
        by_column: dict[str, list[int]] = {}
        low = next((v.level for v in info.levels if v.row_group_start == level.row_group_start), 0) if info.mode == "duplicating" else 0
        for v in info.levels:
            if low <= v.level <= level.level and v.level not in skip:
                by_column.setdefault(planner.column_for_group(info, level, v.level), []).append(v.level)
        counts = F.coalesce(F.col("overview_count"), F.lit(0)) if "overview_count" in self.rows.columns else F.lit(0)
        out = None
        for column, bands in sorted(by_column.items()):
            part = self.rows.where(F.col("band").isin(bands))
            if "bbox" in self.rows.columns:
                part = part.where(C.meets_aoi(F.col("bbox"), aoi))
            part = part.where(F.col(column).isNotNull()).select(F.col("band").cast("int").alias("band"), F.col(column).alias("shape"), counts.cast("int").alias("count"), *extra)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.rows.limit(0).select(F.col("band").cast("int").alias("band"), F.col("geometry").alias("shape"), counts.cast("int").alias("count"), *extra)

    def row(self, key: str, value: Any) -> DataFrame:
        """The attributes of one feature; no row if there is none."""
        return self.rows.where(F.col(key) == value).select(*attribute_columns(self.rows.columns))


@dataclass
class OneFile:
    """A single interoperable file: its rows, its row groups and column chunks as the footers tell them, and its ladder.

    groups: rg, rows, nbytes, row_start, row_end, bbox, band; chunks: rg, column, start, nbytes, codec.
    """

    path: str
    rows: DataFrame
    groups: DataFrame
    chunks: DataFrame
    footer: dict[str, str]

    @property
    def info(self) -> footer.OverviewsInfo | None:
        return footer.parse_overviews(footer.overviews_of(self.footer))

    def scan(self, columns: list[str], ranges: DataFrame) -> DataFrame:
        """Columns of the rows in ranges (row_start, row_end) that do not overlap, each with ``row_index``, its number in
        the file. Ranges are few (row groups or pages of a plan), so they become conditions on the scan."""
        spans = sorted((r.row_start, r.row_end) for r in ranges.select("row_start", "row_end").collect())
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        at = F.col("_metadata.row_index")
        wanted = F.lit(False)
        for a, b in merged:
            wanted = wanted | ((at >= a) & (at < b))
        return self.rows.where(wanted).select(at.alias("row_index"), *columns)


def _leaf_stats(group: Any, leaves: dict[str, int], name: str) -> tuple[float | None, float | None]:
    stats = group.column(leaves[name]).statistics if name in leaves else None
    return (float(stats.min), float(stats.max)) if stats is not None and stats.has_min_max else (None, None)


def _native_stats(group: Any, leaves: dict[str, int], name: str) -> tuple | None:
    """The box of native geometry statistics, where the library and the file have them."""
    geo = getattr(group.column(leaves[name]), "geo_statistics", None) if name in leaves else None
    box = [getattr(geo, c, None) for c in ("xmin", "ymin", "xmax", "ymax")] if geo is not None else [None]
    return None if any(v is None for v in box) else tuple(float(v) for v in box)


def read_file(spark: SparkSession, path: str) -> OneFile:
    """Opens one file of the published format by its footer: what is read here grows with its row groups, not its rows."""
    fs, p = open_path(path)
    with fs.open_input_file(p) as f:
        m = pq.ParquetFile(f).metadata
    kv = {k.decode(): v.decode("utf-8", "replace") for k, v in (m.metadata or {}).items()}
    leaves = {m.schema.column(i).path: i for i in range(m.num_columns)}
    top = {m.schema.column(i).path.split(".")[0] for i in range(m.num_columns)}
    column = footer.geometry_column(sorted(top), kv.get("geo"))
    meta = footer.column_meta(kv.get("geo"), column)
    footer.check_encoding(meta)
    covering = (meta.get("covering") or {}).get("bbox") or {}
    info = footer.parse_overviews(footer.overviews_of(kv))
    groups, chunks, row = [], [], 0
    for k in range(m.num_row_groups):
        g = m.row_group(k)
        sides = [".".join(covering[c]) if c in covering else "" for c in ("xmin", "ymin", "xmax", "ymax")]
        low, high = [_leaf_stats(g, leaves, s)[0] for s in sides[:2]], [_leaf_stats(g, leaves, s)[1] for s in sides[2:]]
        box = tuple([*low, *high]) if None not in [*low, *high] else None
        native = [_native_stats(g, leaves, info.overview_column) if info and info.overview_column else None, _native_stats(g, leaves, column)]
        band = next((v.level for v in info.levels if k <= v.row_group_end), None) if info else None
        nbytes = sum(g.column(i).total_compressed_size for i in range(m.num_columns))
        groups.append((k, g.num_rows, nbytes, row, row + g.num_rows, box, *native, band))
        row += g.num_rows
        for i in range(m.num_columns):
            c = g.column(i)
            start = min(x for x in (c.dictionary_page_offset, c.data_page_offset) if x)
            chunks.append((k, c.path_in_schema, start, c.total_compressed_size if c.num_values > (c.statistics.null_count or 0 if c.statistics else 0) else 0, c.compression))
    box_type = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"
    table = spark.createDataFrame(groups, f"rg int, rows long, nbytes long, row_start long, row_end long, covering {box_type}, coarse {box_type}, exact {box_type}, band int")
    table = table.withColumn("bbox", planner.group_box(F.col("covering"), F.col("coarse"), F.col("exact"))).drop("covering", "coarse", "exact")
    return OneFile(path, read_features(spark, path).rows, table, spark.createDataFrame(chunks, "rg int, column string, start long, nbytes long, codec string"), kv)


def read_layout(spark: SparkSession, path: str) -> Layout:
    """Opens a written layout; band is a SMALLINT again."""
    text = "\n".join(r.value for r in spark.read.text(f"{path}/{SIDECAR}").collect())  # one small JSON document
    meta = json.loads(text)
    rows = spark.read.parquet(f"{path}/rows").withColumn("band", F.col("band").cast("smallint"))
    groups = spark.read.parquet(f"{path}/groups")
    return Layout(path, rows, groups, meta)
