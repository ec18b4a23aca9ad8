"""Table-wide statistics: extent, density, regime. Each is one small aggregate over native columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoladder.options import DENSITY_CELLS, DENSITY_QUANTILE, VERTEX_REGIME_BYTES


@dataclass(frozen=True)
class Extent:
    """What a table spans, with spans never zero."""

    x0: float
    y0: float
    x1: float
    y1: float
    n_valid: int
    n_missing: int
    total_bytes: int

    @property
    def span_x(self) -> float:
        return max(self.x1 - self.x0, 1e-12)

    @property
    def span_y(self) -> float:
        return max(self.y1 - self.y0, 1e-12)

    @property
    def span(self) -> float:
        return max(self.span_x, self.span_y)


def extent_frame(measured: DataFrame) -> DataFrame:
    """One row: bounds, spans, counts and bytes of the valid rows."""
    v = F.col("valid")
    low, high = lambda c: F.min(F.when(v, F.col(c))), lambda c: F.max(F.when(v, F.col(c)))
    one = measured.agg(low("xmin").alias("x0"), low("ymin").alias("y0"), high("xmax").alias("x1"), high("ymax").alias("y1"), F.count_if(v).alias("n_valid"), F.count_if(~v).alias("n_missing"), F.coalesce(F.sum(F.when(v, F.col("nbytes"))), F.lit(0)).alias("total_bytes"))
    one = one.withColumn("span_x", F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-12))).withColumn("span_y", F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-12)))
    return one.withColumn("span", F.greatest("span_x", "span_y"))


def extent(measured: DataFrame) -> Extent:
    """The extent on the driver; a table without a valid geometry is an error."""
    r = extent_frame(measured).first()
    if not r.n_valid:
        raise ValueError("no valid geometry in the input, every row is null or empty")
    return Extent(r.x0, r.y0, r.x1, r.y1, r.n_valid, r.n_missing, r.total_bytes)


def density_histogram(measured: DataFrame, e: Extent, cells: int = DENSITY_CELLS) -> DataFrame:
    """ix, iy, cell_bytes: bytes of the valid rows by the place of their box's middle, on cells x cells."""
    place = lambda c, low, span: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((F.col(c) - low) / span * cells))).cast("bigint")
    return measured.where("valid").groupBy(place("cx", e.x0, e.span_x).alias("ix"), place("cy", e.y0, e.span_y).alias("iy")).agg(F.sum("nbytes").alias("cell_bytes"))


def density_quantile(histogram: DataFrame, e: Extent, cells: int = DENSITY_CELLS, q: float = DENSITY_QUANTILE) -> DataFrame:
    """One row, density: the bytes per area below which a share q of all bytes lies.

    At most cells x cells rows come in, so one window without partitions is bounded.
    """
    area = max((e.span_x / cells) * (e.span_y / cells), 1e-30)
    h = histogram.where("cell_bytes > 0").withColumn("density", F.col("cell_bytes") / F.lit(area))
    order = Window.orderBy("density", "ix", "iy")
    h = h.withColumn("upto", F.sum("cell_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("cell_bytes").over(Window.partitionBy()))
    return h.where(F.col("upto") >= q * F.col("total")).agg(F.coalesce(F.min("density"), F.lit(0.0)).alias("density"))


def regime_frame(measured: DataFrame) -> DataFrame:
    """One row: n_valid, total_bytes, regime (many small features, or few with many vertices)."""
    one = measured.agg(F.count_if("valid").alias("n_valid"), F.coalesce(F.sum(F.when(F.col("valid"), F.col("nbytes"))), F.lit(0)).alias("total_bytes"))
    label = F.when(F.col("n_valid") <= 0, "empty").when(F.col("total_bytes") / F.col("n_valid") >= VERTEX_REGIME_BYTES, "vertex").otherwise("count")
    return one.withColumn("regime", label)
