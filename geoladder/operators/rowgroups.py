"""Physical order and row groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoladder.options import LEAST_COARSE_GROUP_ROWS


def group_of_place(place: Column, rows: int, most: int) -> Column:
    """Row group (from 0) of a row of a coarse band from its place (from 0): equal sizes, the first ones a row longer."""
    k = min(most, max(1, rows // LEAST_COARSE_GROUP_ROWS))
    q, r = rows // k, rows % k
    return F.when(place < r * (q + 1), F.floor(place / (q + 1))).otherwise(r + F.floor((place - r * (q + 1)) / max(q, 1))).cast("int")


def start_of_group(group: Column, rows: int, most: int) -> Column:
    """The place at which such a group begins."""
    k = min(most, max(1, rows // LEAST_COARSE_GROUP_ROWS))
    q, r = rows // k, rows % k
    return F.when(group < r, group.cast("bigint") * (q + 1)).otherwise(r * (q + 1) + (group.cast("bigint") - r) * q)


def greedy_groups(df: DataFrame, order: list[str], bytes_col: str, budget: int, out: str = "rg", by: str | None = None) -> DataFrame:
    """Row group of each row: a new one begins where the bytes so far have reached the budget.

    The rule is sequential, so it runs in one task for each value of ``by`` and needs rows in order; only the
    bytes are looked at, batch by batch, and nothing is gathered. With ``by`` (such as a range of the order) the ranges
    are cut independently.
    """
    schema = df.withColumn(out, F.lit(0)).withColumn(out, F.col(out).cast("int")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, now = 0, 0, None
        for pdf in batches:
            groups = []
            values = pdf[by] if by else [None] * len(pdf)
            for n, v in zip(pdf[bytes_col], values, strict=True):
                if v != now:
                    group, held, now = 0, 0, v
                if held >= budget:
                    group, held = group + 1, 0
                held += int(n)
                groups.append(group)
            pdf[out] = pd.Series(groups, dtype="int32")
            yield pdf[[f.name for f in schema.fields]]

    dealt = df.repartition(F.col(by)).sortWithinPartitions(by, *order) if by else df.repartition(1).sortWithinPartitions(*order)
    return dealt.mapInPandas(run, schema)


def row_offsets(groups: DataFrame, rows: str = "rows", index: str = "rg") -> DataFrame:
    """Adds row_start and row_end of each group of a (small) table of groups."""
    upto = Window.orderBy(index)
    return groups.withColumn("row_start", F.coalesce(F.sum(rows).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("row_end", F.col("row_start") + F.col(rows))


def group_bounds(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, nbytes and box of each group; a group without a valid row has a null box."""
    box = F.struct(F.min("bbox.xmin").alias("xmin"), F.min("bbox.ymin").alias("ymin"), F.max("bbox.xmax").alias("xmax"), F.max("bbox.ymax").alias("ymax"))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("nbytes").alias("nbytes"), F.when(F.count("bbox") > 0, box).alias("bbox"))


def padding(band: Column, pads: list[float]) -> Column:
    """How far a band's boxes are widened; the last band's are exact."""
    out = F.lit(0.0)
    for b, p in enumerate(pads):
        out = F.when(band == b, F.lit(float(p))).otherwise(out)
    return out


def pads(tols: list[float], grids: list[float], has_overview: bool) -> list[float]:
    """Half of the tolerance or grid, whichever is larger; half of the grid where no shape is simplified."""
    return [(max(t, g) if has_overview else g) / 2 for t, g in zip(tols, grids, strict=True)]
