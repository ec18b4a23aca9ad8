"""Which band a row belongs to: ranks, one survivor per cell, shares of a rank order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoladder.operators.stats import Extent
from geoladder.plans import ladder
from geoladder.session import kept

MAX_CELL = (1 << 30) - 1
#: Rows up to which a rank without partitions is one window; beyond, ranks are made by ranges of a quarter of it.
WINDOW_ROWS = 500_000
#: Values up to which a table of them is broadcast.
FEW_VALUES = 50_000


def percentile_desc(df: DataFrame, metric: str, cohort: list[str], out: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Adds 1 for the largest of a cohort, falling towards 0; ties share the better value.

    A rank is one more than the number of rows with greater values, so rows are counted by value first; the values, not
    the rows, are put in order, within sampled ranges whose counts are summed up beforehand. Beyond the ranges' number
    nothing of a cohort meets in one task.
    """
    key = [*cohort, metric]
    values = df.groupBy(*key).agg(F.count("*").alias("__n"))
    n = values.count()
    n_buckets = 1 if n <= window_rows else -(-n // window_rows) * 4
    cuts = sorted(set(values.approxQuantile(metric, [i / n_buckets for i in range(1, n_buckets)], 0.5 / n_buckets))) if n_buckets > 1 else []
    values = values.withColumn("__bucket", _below(F.col(metric).cast("double"), cuts, True))
    sizes = values.groupBy(*cohort, "__bucket").agg(F.sum("__n").alias("__size"))
    every = Window.partitionBy(*cohort)
    upto = every.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(upto), F.lit(0))).withColumn("__all", F.sum("__size").over(every)).drop("__size")
    greater = Window.partitionBy(*cohort, "__bucket").orderBy(F.col(metric).desc()).rowsBetween(Window.unboundedPreceding, -1)
    values = values.join(F.broadcast(sizes), [*cohort, "__bucket"])  # a row per cohort and range
    values = values.withColumn("__rank", F.col("__before") + F.coalesce(F.sum("__n").over(greater), F.lit(0)))
    scored = values.select(*[F.col(k).alias(f"__{k}") for k in key], (1 - F.col("__rank").cast("double") / F.col("__all").cast("double")).alias(out))
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    scored = F.broadcast(scored) if n <= FEW_VALUES else scored  # a row per value
    return df.join(scored, on).drop(*[f"__{k}" for k in key])


def rank_metric(df: DataFrame, dims: set[int], geographic: bool, importance_column: str | None) -> tuple[DataFrame, str]:
    """Adds ``score`` (null: unranked) and says by what rows were ranked.

    Polygons rank by (latitude-scaled) area, lines by length, points by an attribute or not at all. Where dimensions are
    mixed, each is ranked by itself and the percentiles are merged.
    """
    from geoladder.functions.columns import importance, scaled_area

    by_dim = F.when(F.col("dim") >= 2, scaled_area(F.col("area"), F.col("cy"), geographic)).when(F.col("dim") == 1, F.col("length"))
    if importance_column:
        by_dim = by_dim.when(F.col("dim") == 0, importance(F.col(importance_column)))
    df = df.withColumn("metric", F.when(F.col("valid"), by_dim))
    if len(dims) <= 1:
        label = {0: f"attribute:{importance_column}" if importance_column else "grid_thin", 1: "length_desc"}.get(next(iter(dims), 2), "area_desc")
        return df.withColumnRenamed("metric", "score"), label
    ranked = percentile_desc(df.where("metric is not null"), "metric", ["dim"], "score")
    rest = df.where("metric is null").withColumn("score", F.lit(None).cast("double"))
    return ranked.unionByName(rest).drop("metric"), "mixed_quantile_desc"


def cell(value: Column, low: float, size: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(MAX_CELL), F.floor((value - float(low)) / float(size)))).cast("bigint")


def survivors(df: DataFrame, size: float, origin: tuple[float, float], tie: list[Column], metric: str = "score") -> DataFrame:
    """Adds ``survivor`` and ``overview_count`` (a survivor's cell population, else 0).

    A cell of a dimension keeps the valid row with the greatest metric (null is 0), ties by ``tie``, the last of which no
    two rows share. The winner is a minimum that is combined before the shuffle, so a crowded cell costs one row per task,
    not a sort of all its rows.
    """
    keyed = df.withColumn("__ix", cell(F.col("rx"), origin[0], size)).withColumn("__iy", cell(F.col("ry"), origin[1], size))
    rank = F.struct((-F.coalesce(F.nanvl(F.col(metric), F.lit(0.0)), F.lit(0.0))).alias("m"), *[t.alias(f"t{i}") for i, t in enumerate(tie)])
    best = keyed.where("valid").groupBy("dim", "__ix", "__iy").agg(F.min(rank).alias("__best"), F.count("*").alias("__n"))
    best = best.select(F.col("dim").alias("__dim"), F.col("__ix").alias("__jx"), F.col("__iy").alias("__jy"), F.col(f"__best.t{len(tie) - 1}").alias("__best"), "__n")
    joined = keyed.join(best, (F.col("dim") == F.col("__dim")) & (F.col("__ix") == F.col("__jx")) & (F.col("__iy") == F.col("__jy")), "left")
    won = F.coalesce(F.col("valid") & (tie[-1] == F.col("__best")), F.lit(False))
    return joined.withColumn("survivor", won).withColumn("overview_count", F.when(won, F.col("__n")).otherwise(F.lit(0)).cast("bigint")).drop("__ix", "__iy", "__dim", "__jx", "__jy", "__best", "__n")


def _below(value: Column, cuts: list[float], falls: bool) -> Column:
    """How many of the rising ``cuts`` lie before a value, in blocks so that a value meets two square roots of them."""
    if not cuts:
        return F.lit(0)
    line = lambda values: F.array(*[F.lit(float(c)) for c in values]).cast("array<double>")
    size = math.ceil(len(cuts) ** 0.5)
    cuts = cuts[::-1] if falls else cuts
    count = lambda at: F.size(F.filter(at, lambda c: (c > value) if falls else (c < value)))
    blocks = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    block = count(line([x[0] for x in blocks]))  # the last block that begins before the value
    return F.when(block == 0, 0).otherwise((block - 1) * size + count(F.element_at(F.array(*[line(x) for x in blocks]), F.greatest(block, F.lit(1)))))


def numbered(df: DataFrame, order: list[tuple[str, bool]], out: str, rows: int | None = None, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Adds each row's place (from 0) in an order of all rows.

    ``order``: (column, descending) of a total order of numbers, nulls last. Up to ``window_rows`` rows one window numbers
    them. A larger table is dealt into buckets by sampled ranges of its first column, and rows that tie there (nulls, or a
    value that fills a range by itself) by the next one; bucket counts give each bucket's first place, and only within
    buckets rows are numbered, so no task sees all rows. There are as many tasks as ranges: left to their bytes, which
    compress well, buckets would be put together again.
    """
    by = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in order]
    n = rows if rows is not None else df.count()
    if n <= window_rows:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*by)) - 1)
    n_buckets = max(2, -(-n // window_rows) * 4)
    shares, error = [i / n_buckets for i in range(1, n_buckets)], 0.5 / n_buckets
    places, tied, left = [], F.lit(True), n
    for k, (column, down) in enumerate(order):
        if k:
            left = df.where(tied).count()
            if left <= n // n_buckets:
                break
        key = F.col(column).cast("double")
        key = F.when(key == 0, F.lit(0.0)).otherwise(key)  # one zero
        found = df.where(tied & key.isNotNull()).select(key.alias("k")).approxQuantile("k", shares, error)
        cuts = sorted({c + 0.0 for c in found})
        # a value that is a cut more than once holds more than a range's share of the rows
        heavy = sorted({c + 0.0 for c in cuts if found.count(c) > 1})
        # every cut is a range of its own between those before and after it, nulls are the last one
        place = F.when(key.isNull(), 2 * len(cuts) + 1).otherwise(2 * _below(key, cuts, down) + (key.isin(cuts) if cuts else F.lit(False)).cast("int"))
        places.append(F.when(tied, place).otherwise(0).alias(f"p{k}"))
        tied = tied & (key.isNull() | (key.isin(heavy) if heavy else F.lit(False)))
    df = df.withColumn("__bucket", F.struct(*places))
    sizes = df.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = df.join(F.broadcast(before), F.col("__bucket") == F.col("__b")).repartition(n_buckets, "__bucket")  # a row per bucket
    placed = placed.withColumn(out, F.col("__before") + F.row_number().over(Window.partitionBy("__bucket").orderBy(*by)) - 1)
    return placed.drop("__bucket", "__b", "__before")


def ranked_bands(df: DataFrame, order: list[tuple[str, bool]], edges: list[int], out: str = "band", rows: int | None = None, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Adds the band that a row's place falls into, given the places where bands begin; see ``numbered``."""
    placed = numbered(df, order, "__place", rows, window_rows)
    return placed.withColumn(out, _band_of(F.col("__place"), edges)).drop("__place")


def _band_of(place: Column, edges: list[int]) -> Column:
    band = F.lit(0)
    for b, e in enumerate(edges[1:-1], 1):
        band = F.when(place >= e, F.lit(b)).otherwise(band)
    return band.cast("int")


def renumber(df: DataFrame, column: str = "band") -> DataFrame:
    """Bands without rows vanish: the present ones are numbered from 0 in their order."""
    present = df.select(column).distinct()
    dense = present.withColumn("__new", (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int")).withColumnRenamed(column, "__old")
    return df.join(F.broadcast(dense), F.col(column) == F.col("__old")).withColumn(column, F.col("__new")).drop("__old", "__new")  # ten rows at most


def stratified_points(df: DataFrame, bands: int, tols: list[float], origin: tuple[float, float], row: str = "row_id") -> DataFrame:
    """Adds ``band``: the coarsest band in which a row is the first of its cell among rows without a band; else the last.

    Used for points without an attribute when thinning is off.
    """
    df = df.withColumn("band", F.lit(None).cast("int"))
    for b, size in enumerate(tols):
        free = F.col("valid") & F.col("band").isNull()
        key = [F.floor((F.col(c) - float(o)) / float(size)).cast("bigint") for c, o in zip(("cx", "cy"), origin, strict=True)]
        first = F.min(F.when(free, F.col(row))).over(Window.partitionBy(*key))
        df = df.withColumn("band", F.when(free & (F.col(row) == first), F.lit(b)).otherwise(F.col("band")))
    return df.withColumn("band", F.coalesce("band", F.lit(bands - 1)).cast("int"))


def assign(df: DataFrame, bands: int, e: Extent, thin: bool, coarsest_rel: float, factor: float, fractions: tuple[float, ...] | None, tie: list[Column], row: str = "row_id", path: str | None = None) -> DataFrame:
    """``row``, ``band`` and ``overview_count`` of each of the rows with valid, dim, score, rx, ry, cx, cy.

    With thinning, band 0 is one survivor per cell over the whole extent; the others are cut by rank into the bands from
    1 on. Unranked rows come after all ranked ones, in row order. Invalid rows are in the last band. Empty bands vanish.
    Which rows survive is written once, in the work folder or at ``path``, since ranking reads it several times.
    """
    last = bands - 1
    order = [("score", True), (row, False)]
    none = F.lit(0).cast("bigint").alias("overview_count")
    if bands == 1:
        return df.select(row, F.lit(0).alias("band"), none)
    if not thin:
        points = df.where("valid and score is null")
        ranked = df.where("valid and score is not null")
        parts = [df.where("not valid").withColumn("band", F.lit(last))]
        n = ranked.count()
        parts.append(ranked_bands(ranked, order, ladder.band_edges(n, bands, fractions), rows=n))
        parts.append(stratified_points(points, bands, ladder.tolerances(bands, e.span, coarsest_rel, factor), (e.x0, e.y0), row))
        out = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return renumber(out.select(row, "band", none))
    marked = survivors(df, e.span * coarsest_rel, (e.x0, e.y0), tie)
    group = F.when(~F.col("valid"), 2).when(F.col("survivor"), 0).otherwise(1)
    marked = kept(marked.select(row, "score", group.alias("__group"), "overview_count"), "marked", path)
    sizes = {r["__group"]: r["count"] for r in marked.groupBy("__group").count().collect()}  # three rows at most
    n = sizes.get(1, 0)
    edges = ladder.band_edges(n, last, fractions)
    # bands without rows vanish; a band of losers has rows where the place at which it begins is one
    full = {0} if sizes.get(0) else set()
    full |= {1 + max(b for b, f in enumerate(edges[:-1]) if not b or f <= at) for at in edges if at < n}
    full |= {last} if sizes.get(2) else set()
    dense = lambda band: F.element_at(F.array(*[F.lit(sum(f < b for f in full)) for b in range(bands)]), band + 1).cast("int")
    losers = ranked_bands(marked.where("__group = 1"), order, edges, rows=n).withColumn("band", dense(F.col("band") + 1))
    rest = marked.where("__group <> 1").withColumn("band", dense(F.when(F.col("__group") == 0, 0).otherwise(last)))
    return losers.unionByName(rest).select(row, "band", "overview_count")
