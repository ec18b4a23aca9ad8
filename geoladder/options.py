"""Settings of a layout and their checks."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the layout format.
FINEST_ZOOM = 24
SCREEN_PX = 1024
ZOOMS_PER_BAND = 2
MOST_COARSE_BANDS = 9
DENSITY_CELLS = 128
DENSITY_QUANTILE = 0.9
VERTEX_REGIME_BYTES = 2000
GRID_PARTS = 4
LEAST_COARSE_GROUP_ROWS = 1024
COARSE_SHARE = 0.10
MEGABYTE = 1_000_000
FORMAT_VERSION = "0.3.0"
RESERVED = ("geometry", "geom_overview", "band", "bbox", "overview_count")


@dataclass(frozen=True)
class LayoutOptions:
    """What shapes a layout; the defaults suit most tables.

    bands: 0 derives the number, otherwise it is forced (and still limited by the zoom ceiling).
    screen_budget_mb: decoded exact geometry that a screen may cost.
    row_group_mb: budget of a row group of the exact band.
    overview_grid: one snap grid for all bands instead of a quarter of each band's tolerance.
    coarse_row_groups: row groups per coarse band at most.
    compression_level, page_size_kb: of the written Parquet files.
    importance_column: numeric column that ranks points.
    native_geo: native geometry typing in the single-file export.
    bbox: None decides by the table's regime.
    jobs: accepted for compatibility; Spark decides on parallelism.
    thin: one survivor per cell in band 0.
    coarsest_rel, ladder_factor: first tolerance as a share of the extent, and the step between bands.
    band_fractions: explicit shares of the bands.
    """

    bands: int = 0
    screen_budget_mb: float = 8.0
    row_group_mb: float = 16.0
    overview_grid: float | None = None
    coarse_row_groups: int = 32
    compression_level: int = 15
    page_size_kb: int = 128
    importance_column: str | None = None
    native_geo: bool = True
    bbox: bool | None = None
    jobs: int = 0
    thin: bool = True
    coarsest_rel: float = 1 / 1500
    ladder_factor: float = 4.0
    band_fractions: tuple[float, ...] | None = None

    def validate(self) -> LayoutOptions:
        """Raises ValueError, with the messages that users of the format know."""
        most = MOST_COARSE_BANDS + 1
        rules = (
            (self.bands < 0, f"bands must be 0 (derive) or a positive count, got {self.bands}"),
            (self.bands > most, f"bands must be at most {most} ({MOST_COARSE_BANDS} coarse plus the exact band), got {self.bands}"),
            (self.screen_budget_mb <= 0, f"screen_budget_mb must be positive, got {self.screen_budget_mb}"),
            (self.row_group_mb <= 0, f"row_group_mb must be positive, got {self.row_group_mb}"),
            (self.coarse_row_groups < 1, f"coarse_row_groups must be at least 1, got {self.coarse_row_groups}"),
            (self.jobs < 0, f"jobs must be 0 (auto) or a positive count, got {self.jobs}"),
            (self.overview_grid is not None and self.overview_grid <= 0, f"overview_grid must be positive, got {self.overview_grid}"),
            (self.compression_level < 1, f"compression_level must be at least 1, got {self.compression_level}"),
            (self.page_size_kb < 1, f"page_size_kb must be at least 1, got {self.page_size_kb}"),
            (self.bbox is False and not self.native_geo, "--no-bbox requires native geo types, there would be no pruning surface at all"),
        )
        for broken, message in rules:
            if broken:
                raise ValueError(message)
        return self
