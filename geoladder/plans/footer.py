"""The two footer blocks: ``geo`` for every reader, ``overviews`` for readers that know levels; and reading them."""

from __future__ import annotations

import json
import logging
import math
import re
from dataclasses import dataclass, field
from typing import Any

from geoladder.options import FORMAT_VERSION

log = logging.getLogger(__name__)
# Fixed value: where the covering's four numbers are.
COVERING = {"bbox": {side: ["bbox", side] for side in ("xmin", "ymin", "xmax", "ymax")}}
ABSENT: Any = object()


def _json(raw: bytes | str | None) -> dict | None:
    if not raw:
        return None
    try:
        out = json.loads(raw)
    except ValueError:
        log.warning("a footer block is not valid JSON and is ignored")
        return None
    return out if isinstance(out, dict) else None


def geometry_column(columns: list[str], geo: bytes | str | None) -> str:
    """The column that ``geo`` names, else one called geometry."""
    named = (_json(geo) or {}).get("primary_column")
    for c in (named, "geometry"):
        if c and c in columns:
            return c
    raise ValueError("no geometry column found, expected a `geo` footer block or a `geometry` column")


def column_meta(geo: bytes | str | None, column: str) -> dict:
    """What ``geo`` says of a column."""
    columns = (_json(geo) or {}).get("columns")
    entry = columns.get(column) if isinstance(columns, dict) else None
    return entry if isinstance(entry, dict) else {}


def check_encoding(entry: dict) -> None:
    if entry.get("encoding", "WKB") != "WKB":
        raise ValueError(f"unsupported geometry encoding {entry['encoding']!r}, only WKB is supported")


def geo_block(bbox: tuple | list, types: list[str], source: dict | None = None, crs: Any = ABSENT, overview_types: list[str] | None = None, covering: bool = True) -> str:
    """The ``geo`` block. What the source says of its column stays, besides what is computed here; an overview column has
    types of its own and never a covering."""
    source = {k: v for k, v in (source or {}).items() if k not in ("covering", "crs")}
    base = source | {"encoding": "WKB", "bbox": list(bbox)} | ({} if crs is ABSENT else {"crs": crs})
    columns = {"geometry": base | {"geometry_types": types} | ({"covering": COVERING} if covering else {})}
    if overview_types is not None:
        columns["geom_overview"] = base | {"geometry_types": overview_types}
    return json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": columns})


def overviews_block(levels: list[dict], importance: str, method: str, regime: str, has_overview: bool, covering: bool = True, count_column: str | None = None, version: str = FORMAT_VERSION) -> str:
    """The ``overviews`` block: how rows were ranked and reduced, and the ladder."""
    optional = {"covering": COVERING if covering else None, "overview_column": "geom_overview" if has_overview else None, "count_column": count_column}
    fixed = {"version": version, "spatial_key": "hilbert", "importance": importance, "regime": regime, "overview_method": method}
    return json.dumps(fixed | {k: v for k, v in optional.items() if v is not None} | {"levels": levels})


@dataclass
class LevelInfo:
    level: int
    row_group_start: int
    row_group_end: int
    min_zoom: float
    max_zoom: float
    gsd: float
    feature_count: int | None = None
    bytes: tuple[float, float] | None = None
    extent: tuple[float, ...] | None = None


@dataclass
class OverviewsInfo:
    version: str
    mode: str
    spatial_key: str
    overview_column: str | None
    overview_method: str | None
    importance: str | None
    count_column: str | None
    levels: list[LevelInfo] = field(default_factory=list)

    @property
    def own_grids(self) -> bool:
        """Whether each band has a grid of its own (from draft 0.3 on)."""
        m = re.match(r"(\d+)\.(\d+)", self.version.strip())
        return bool(m) and (int(m[1]), int(m[2])) >= (0, 3)


def overviews_of(metadata: dict[str, Any]) -> dict | None:
    """The raw block of a footer; the plain key wins over the prefixed one."""
    for k in ("overviews", "geo:overviews"):
        if metadata.get(k):
            return _json(metadata[k])
    return None


def parse_overviews(raw: dict | None) -> OverviewsInfo | None:
    """The ladder of a footer in either of its dialects; None if it has no levels."""
    levels = (raw or {}).get("levels")
    if not isinstance(levels, list) or not levels:
        return None
    tuple_of = lambda v, n: tuple(float(x) for x in v) if isinstance(v, list) and len(v) == n else None
    out = []
    for i, entry in enumerate(levels):
        zoom = entry.get("max_zoom", entry.get("zoom"))
        low, count = entry.get("min_zoom"), entry.get("feature_count")
        out.append(LevelInfo(int(entry.get("level", i)), 0, int(entry["row_group_end"]), math.nan if low is None else low, math.nan if zoom is None else zoom, float(entry.get("gsd") if entry.get("gsd") is not None else math.nan), None if count is None else int(count), tuple_of(entry.get("bytes"), 2), tuple_of(entry.get("extent"), 4)))
    out.sort(key=lambda v: v.level)
    mode = "duplicating" if raw.get("mode") == "duplicating" else "banded"
    for before, v in zip([None, *out], out, strict=False):
        if mode == "duplicating" and before:
            v.row_group_start = before.row_group_end + 1
        if not math.isfinite(v.min_zoom):
            v.min_zoom = min(before.max_zoom + 1, v.max_zoom) if before else 0
    text = lambda k: raw[k] if isinstance(raw.get(k), str) else None
    return OverviewsInfo(str(raw.get("version") or ""), mode, str(raw.get("spatial_key") or ""), text("overview_column"), text("overview_method"), text("importance"), text("count_column"), out)


# Fixed value: the geometry types that can be drawn.
RENDERABLE = {"Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection"}


def renderable(types: list[str] | None) -> bool:
    """Types that are not known count as renderable, an empty list does not."""
    return types is None or any(str(t).split(" ")[0] in RENDERABLE for t in types)
