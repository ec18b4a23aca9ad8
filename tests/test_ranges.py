"""Steps that large tables go through in ranges: no task sees all rows, pairs do not grow with a square, nothing is made twice."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from geoladder.catalog import fixtures as X
from geoladder.catalog import layout_queries, plan_queries
from geoladder.convert import RANGE_GROUPS, convert
from geoladder.functions import wkb
from geoladder.operators import banding
from geoladder.options import LayoutOptions
from geoladder.plans import planner
from geoladder.sources import reader

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_windows(monkeypatch):
    monkeypatch.setattr(banding.numbered, "__defaults__", (None, 200))


def largest_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def same_as_sql(df, sql):
    c = duckdb.connect()
    for t in ("orders", "part", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cols = df.columns
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted((tuple(r) for r in c.execute(f"select {', '.join(cols)} from ({sql})").fetchall()), key=str)


def test_points_are_grouped_in_ranges(spark, small_windows):
    g = X.grouped(spark, SF)
    assert largest_task(g) < 750  # of 1,500
    same_as_sql(g.select("id", "rg"), layout_queries.COARSE_NTILE_GROUPS)
    same_as_sql(X.pages(spark, SF).select("rg", "page", "row_start", "row_end"), f"WITH {X.PAGES} SELECT rg, page, row_start, row_end FROM page_t")


def test_places_by_the_third_column(spark):
    """Rows that tie in two columns are dealt by the next one; both zeros are one value."""
    rows = [(1.0, 2.0 if i % 9 else None, i) for i in range(600)] + [(0.0 if i % 2 else -0.0, 0.0, 600 + i) for i in range(300)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "a double, b double, id long")
    got = banding.numbered(df, [("a", True), ("b", False), ("id", False)], "n", window_rows=100)
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0.0, r[2]))
    assert {r.id: r.n for r in got.collect()} == {r[2]: n for n, r in enumerate(want)}
    assert largest_task(got) < 300


def test_attributes_are_placed_in_ranges(spark, small_windows):
    assert "windowspecdefinition(score" not in plan(layout_queries.attribute_rank(spark, SF))
    same_as_sql(layout_queries.attribute_rank(spark, SF), layout_queries.ATTRIBUTE_RANK)


@pytest.mark.parametrize("name", ["columns_and_groups", "viewport_read", "planned_bytes_sweep", "rowgroup_prune", "file_facts"])
def test_groups_are_made_once(spark, name):
    assert "parquet" not in plan(plan_queries.QUERIES[name](spark, SF))


def test_uncached_ranges_meet_by_spans(spark):
    r, want, held = random.Random(5), [], []
    for rg in (1, 2):
        at = 0
        while at < 60_000:
            end = at + r.choice([1, 50, 300, 5_000, 20_000])
            if r.random() < 0.6:
                held.append((rg, "g", at, end))
            at = end + r.choice([0, 0, 7])
        want += [(rg, c, a, a + r.choice([1, 100, 9_000])) for c in ("g", "h") for a in range(0, 60_000, 777)]
    kind = "rg int, column string, row_start long, row_end long"
    out = planner.uncached_ranges(spark.createDataFrame(want, kind), spark.createDataFrame(held, kind))
    expected = []
    for rg, c, a, b in set(want):
        for _, _, x, y in sorted(h for h in held if h[:2] == (rg, c) and h[2] < b and h[3] > a):
            expected += [(rg, c, a, x)] if a < x else []
            a = y
        expected += [(rg, c, a, b)] if a < b else []
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    assert "span" in plan(out)


def test_counts_of_long_arrays_are_taken_in_parts(spark):
    n = 150_000
    arrays = spark.range(1).select(F.lit(70_000).cast("long").alias("row_start"), F.lit(70_000 + n).cast("long").alias("row_end"), F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: i % 11).alias("counts"))
    out = planner.counts_for_rows(spark.range(60_000, 240_000).select(F.col("id").alias("row_id")), arrays)
    assert "slice(counts" in plan(out)
    bad = out.where(F.col("count") != F.when(F.col("row_id").between(70_000, 70_000 + n - 2), (F.col("row_id") - 70_000) % 11).otherwise(0))
    assert out.count() == 180_000 and bad.count() == 0


@pytest.mark.parametrize("name", ["band_assignment_line", "band_assignment_mixed", "band_assignment_polygon"])
def test_survivors_are_marked_once(spark, small_windows, name):
    out = layout_queries.QUERIES[name](spark, SF)
    assert out.inputFiles() and all("/marked-" in f for f in out.inputFiles())
    same_as_sql(out, layout_queries.ORACLE_SQL[name])


def test_few_values_are_broadcast(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("m"), F.lit(1).alias("dim"))
    assert "strategy=broadcast" in plan(banding.percentile_desc(df, "m", ["dim"], "p"))


def test_shapes_at_one_place_are_cut_in_ranges(spark, tmp_path):
    square = bytearray(wkb.polygon([[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]))
    src = spark.createDataFrame([(i, square) for i in range(120)], "id long, geometry binary")
    budget = 3 * len(square)
    convert(spark, src, str(tmp_path / "a"), LayoutOptions(bands=2, coarsest_rel=1 / 40, row_group_mb=budget / 1e6))
    groups = reader.read_layout(spark, str(tmp_path / "a")).groups.where("band = 1").collect()
    ranges = -(-120 * len(square) // (budget * RANGE_GROUPS))
    assert sum(g.rows for g in groups) == 119 and max(g.rows for g in groups) == 3
    assert 1 < sum(g.rows < 3 for g in groups) <= ranges
    assert not list(tmp_path.glob("a-*"))
