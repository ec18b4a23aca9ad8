"""Level records: one row per band, with what a reader needs to price and plan a read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoladder.plans import ladder


def level_frame(rows: DataFrame) -> DataFrame:
    """level, feature_count, row_group_end, extent and bytes per band, from rows with band, rg, bbox, nbytes."""
    box = F.struct(F.min("bbox.xmin").alias("xmin"), F.min("bbox.ymin").alias("ymin"), F.max("bbox.xmax").alias("xmax"), F.max("bbox.ymax").alias("ymax"))
    per = rows.groupBy(F.col("band").alias("level")).agg(F.count("*").alias("feature_count"), F.countDistinct("rg").alias("groups"), F.when(F.count("bbox") > 0, box).alias("extent"), F.sum("nbytes").alias("nbytes"))
    upto = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # ten rows at most
    return per.withColumn("row_group_end", F.sum("groups").over(upto) - 1).drop("groups")


def level_records(level_rows: list, tols: list[float], grids: list[float], world: float) -> list[dict]:
    """The ladder of the footer, from the rows of ``level_frame`` in order."""
    zooms, out = ladder.zoom_ranges(tols, world), []
    for r, (low, high) in zip(level_rows, zooms, strict=True):
        b, last = r.level, r.level == len(tols)
        box = None if r.extent is None else [r.extent.xmin, r.extent.ymin, r.extent.xmax, r.extent.ymax]
        out.append({"level": b, "row_group_end": int(r.row_group_end), "max_zoom": high, "gsd": 0.0 if last else tols[b], "min_zoom": low, "grid": None if last else {"origin": [0.0, 0.0], "cell_size": grids[b]}, "feature_count": int(r.feature_count), "extent": box})
    return out
