import json
import math
import random
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from geoladder import queries as core
from geoladder.convert import convert
from geoladder.functions import kernels, wkb
from geoladder.operators import banding, rowgroups
from geoladder.options import LayoutOptions
from geoladder.sources import catalog, reader, writer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, duck, name):
    a = core.QUERIES[name](spark, SF).toPandas()
    b = duck.execute(core.ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    pd.testing.assert_frame_equal(a[cols].sort_values(cols).reset_index(drop=True), b[cols].sort_values(cols).reset_index(drop=True), check_dtype=False, check_exact=True)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def clustered(n, seed=1, attribute=False):
    r = random.Random(seed)
    rows = []
    for _ in range(n // 30):
        cx, cy = r.uniform(0, 10), r.uniform(0, 10)
        for _ in range(30):
            x, y, h = cx + r.gauss(0, 0.05), cy + r.gauss(0, 0.05), r.uniform(0.001, 0.05)
            ring = [[x + h * math.cos(2 * math.pi * i / 40), y + h * math.sin(2 * math.pi * i / 40)] for i in range(40)]
            rows.append((len(rows), bytearray(wkb.polygon([*ring, ring[0]])), f"n{len(rows) % 5}"))
    return rows


SCHEMA = "id bigint, geometry binary, name string"
OPTIONS = LayoutOptions(bands=4, coarsest_rel=1 / 40)


def made(spark, rows, path, options=OPTIONS):
    src = spark.createDataFrame(rows, SCHEMA)
    summary = convert(spark, src, str(path), options)
    return summary, reader.read_layout(spark, str(path))


def test_convert_invariants(spark, tmp_path):
    rows = clustered(600)
    rows[5] = (5, None, "null")
    rows[123] = (123, bytearray(wkb.encode([], wkb.MULTIPOLYGON)), "empty")
    summary, layout = made(spark, rows, tmp_path / "a")
    out = layout.rows.collect()
    assert sorted((r.id, zlib.crc32(bytes(r.geometry)) if r.geometry is not None else None) for r in out) == sorted((i, zlib.crc32(bytes(g)) if g is not None else None) for i, g, _ in rows)
    levels = summary["levels"]
    assert sum(v["feature_count"] for v in levels) == 600 and [v["level"] for v in levels] == list(range(len(levels)))
    assert levels[0]["min_zoom"] == 0 and all(b["min_zoom"] == a["max_zoom"] + 1 for a, b in zip(levels, levels[1:]))
    last = levels[-1]["level"]
    counts = [r.overview_count for r in out if r.band == 0]
    assert sum(counts) == 598 and all(r.overview_count is None for r in out if r.band > 0)
    for r in out:
        if r.id in (5, 123):
            assert r.band == last and r.bbox is None and r.geom_overview is None
        elif r.band < last:
            tol, grid = levels[r.band]["gsd"], levels[r.band]["grid"]["cell_size"]
            b, g = r.bbox, kernels.bounds(wkb.parse(bytes(r.geom_overview))[1])
            e = kernels.bounds(wkb.parse(bytes(r.geometry))[1])
            assert b.xmin <= g[0] + 1e-9 and b.ymin <= g[1] + 1e-9 and b.xmax >= g[2] - 1e-9 and b.ymax >= g[3] - 1e-9
            assert abs(e[0] - b.xmin - max(tol, grid) / 2) < 1e-9
        else:
            assert r.geom_overview is None and r.bbox.xmin == kernels.bounds(wkb.parse(bytes(r.geometry))[1])[0]
    assert all(math.isfinite(v) for v in levels[0]["extent"]) and summary["overview_method"] == "simplify_snap" and summary["importance"] == "area_desc"
    groups = layout.groups.collect()
    assert sum(g.rows for g in groups) == 600 and max(g.rg for g in groups) == levels[-1]["row_group_end"]


def test_order_does_not_matter(spark, tmp_path):
    rows = clustered(300)
    a = made(spark, rows, tmp_path / "a")[1].rows.select("id", F.col("band").cast("int"), "overview_count").collect()
    random.Random(3).shuffle(rows)
    b = made(spark, rows, tmp_path / "b")[1].rows.select("id", F.col("band").cast("int"), "overview_count").collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_viewport_reads_prefix(spark, tmp_path):
    rows = clustered(600)
    summary, layout = made(spark, rows, tmp_path / "a")
    zoom = summary["levels"][1]["max_zoom"]
    got = layout.viewport((2, 2, 8, 8), zoom, ["id"]).collect()
    assert {r.band for r in got} <= {0, 1} and got
    exact = {i: bytes(g) for i, g, _ in rows}
    assert all(bytes(r.shape) == exact[r.id] for r in got if r.band == 0)
    every = layout.viewport((-1, -1, 11, 11), 24, ["id"]).collect()
    assert {r.id for r in every} == set(exact) and all(bytes(r.shape) == exact[r.id] for r in every)
    assert layout.row("id", 7).collect()[0].name == "n2" and layout.row("id", -1).count() == 0


def test_single_band_points_and_errors(spark, tmp_path):
    pts = [(i, bytearray(wkb.point(i % 10, i // 10)), "p") for i in range(100)]
    s, layout = made(spark, pts, tmp_path / "a", LayoutOptions(bands=3))
    assert s["bands"] == 1 and s["overview_method"] == "none" and "geom_overview" not in layout.rows.columns and "overview_count" not in layout.rows.columns
    copies = [(i, bytearray(wkb.point(i % 10 * 10, 0)), "p") for i in range(100)]
    s, layout = made(spark, copies, tmp_path / "b", LayoutOptions(bands=3))
    assert s["overview_method"] == "thin" and s["levels"][0]["feature_count"] == 10 and s["importance"] == "grid_thin"
    assert [r.overview_count for r in layout.rows.where("band = 0").collect()] == [10] * 10
    with pytest.raises(ValueError):
        convert(spark, spark.createDataFrame([], SCHEMA), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        convert(spark, spark.createDataFrame([(1, None, "x")], SCHEMA), str(tmp_path / "d"))
    for column in ("missing", "name"):
        with pytest.raises(ValueError):
            convert(spark, spark.createDataFrame(pts, SCHEMA), str(tmp_path / "e"), LayoutOptions(importance_column=column))


def test_attribute_and_no_thin(spark, tmp_path):
    rows = [(c * 10 + k, bytearray(wkb.point(c * 100.0, k * 1e-6)), f"{c * 10 + k}") for c in range(5) for k in range(10)]
    src = spark.createDataFrame(rows, SCHEMA).withColumn("weight", F.col("name").cast("double"))
    s = convert(spark, src, str(tmp_path / "a"), LayoutOptions(bands=2, importance_column="weight"))
    got = reader.read_layout(spark, str(tmp_path / "a")).rows.where("band = 0").select("id").collect()
    assert sorted(r.id for r in got) == [9, 19, 29, 39, 49] and s["importance"] == "attribute:weight"
    s = convert(spark, src, str(tmp_path / "b"), LayoutOptions(bands=2, importance_column="weight", thin=False, band_fractions=(0.2,)))
    got = reader.read_layout(spark, str(tmp_path / "b")).rows
    assert "overview_count" not in got.columns and sorted(r.id for r in got.where("band = 0").collect()) == list(range(40, 50))


def test_footer_passes_and_export(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = clustered(150)
    table = pa.table({"id": [r[0] for r in rows], "geom": [bytes(r[1]) for r in rows], "name": [r[2] for r in rows]})
    geo = {"version": "1.1.0", "primary_column": "geom", "columns": {"geom": {"encoding": "WKB", "crs": None, "edges": "planar"}}}
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(geo), "mine": "kept"}), tmp_path / "in.parquet")
    s = convert(spark, str(tmp_path / "in.parquet"), str(tmp_path / "out"), OPTIONS)
    assert s["crs_preserved"] and s["geographic"]
    layout = reader.read_layout(spark, str(tmp_path / "out"))
    assert layout.footer["mine"] == "kept" and json.loads(layout.footer["geo"])["columns"]["geometry"]["edges"] == "planar"
    one = writer.export_file(spark, str(tmp_path / "out"), str(tmp_path / "one.parquet"), OPTIONS)
    m = pq.read_metadata(one)
    info = layout.info
    assert m.num_rows == 150 and m.num_row_groups == info.levels[-1].row_group_end + 1
    kv = {k.decode(): v.decode() for k, v in m.metadata.items()}
    assert json.loads(kv["overviews"])["version"] == "0.3.0" and kv["mine"] == "kept"
    bands = pq.read_table(one, columns=["band"])["band"].to_pylist()
    assert bands == sorted(bands)
    native = writer.export_file(spark, str(tmp_path / "out"), str(tmp_path / "native.parquet"), OPTIONS, native=True)
    again = reader.read_features(spark, native)
    assert again.geometry == "geometry" and again.rows.count() == 150
    # a layout can be converted again
    s2 = convert(spark, one, str(tmp_path / "again"), OPTIONS)
    assert [v["feature_count"] for v in s2["levels"]] == [v["feature_count"] for v in s["levels"]]


def test_export_carries_bytes_and_crs(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from geoladder.plans import footer, planner

    rows = clustered(150)
    crs = {"type": "ProjectedCRS", "name": "plane", "id": {"authority": "EPSG", "code": 3067}}
    geo = {"version": "1.1.0", "primary_column": "geom", "columns": {"geom": {"encoding": "WKB", "crs": crs}}}
    table = pa.table({"id": [r[0] for r in rows], "geom": [bytes(r[1]) for r in rows], "name": [r[2] for r in rows]})
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(geo)}), tmp_path / "in.parquet")
    convert(spark, str(tmp_path / "in.parquet"), str(tmp_path / "out"), OPTIONS)
    m = pq.read_metadata(writer.export_file(spark, str(tmp_path / "out"), str(tmp_path / "native.parquet"), OPTIONS, native=True))
    info = footer.parse_overviews(json.loads(m.metadata[b"overviews"]))
    first = 0
    for v in info.levels:
        chunks = [m.row_group(g).column(c) for g in range(first, v.row_group_end + 1) for c in range(m.num_columns)]
        begin = min(min(c.data_page_offset, c.dictionary_page_offset or c.data_page_offset) for c in chunks)
        end = max(min(c.data_page_offset, c.dictionary_page_offset or c.data_page_offset) + c.total_compressed_size for c in chunks)
        assert v.bytes == (begin, end)
        first = v.row_group_end + 1
    assert planner.prefix_bytes(info, len(info.levels) - 1) == (4, info.levels[-1].bytes[1])
    kind = next(m.schema.column(i).logical_type for i in range(m.num_columns) if m.schema.column(i).name == "geometry")
    assert "3067" in str(kind)


def test_large_ranks_without_a_single_task(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 != 0, (F.col("id") * 7919 % 5003).cast("double")).alias("score"))
    order, edges = [("score", True), ("row_id", False)], [0, 100, 700, 4700, 5000]
    a = banding.ranked_bands(df, order, edges, rows=5000)
    b = banding.ranked_bands(df, order, edges, rows=5000, window_rows=300)
    assert sorted(map(tuple, a.select("row_id", "band").collect())) == sorted(map(tuple, b.select("row_id", "band").collect()))


def test_greedy_plan(spark):
    sizes = [10] * 100 + [10] * 100 + [100] * 50
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id bigint, nbytes bigint").where("id >= 200")
    got = [r.n for r in rowgroups.greedy_groups(df, ["id"], "nbytes", 250).groupBy("rg").agg(F.count("*").alias("n")).orderBy("rg").collect()]
    assert got == [3] * 16 + [2]


def test_catalogue(spark):
    doc = {"latest": "b", "base": "x", "versions": [{"version": "a", "prefix": "a", "datasets": [{"id": "1", "label": "A1", "path": "p"}]}, {"version": "b", "prefix": "b", "datasets": [{"id": "1", "label": "B1", "path": "p"}, {"id": "2", "label": "B2", "path": "q"}]}]}
    df = spark.createDataFrame([(json.dumps(doc),), ("{broken",)], "text string")
    sets = catalog.datasets(df)
    assert sets.count() == 3
    assert sorted(map(tuple, catalog.twins(sets, "b", "a").collect())) == [("1", "B1", "A1"), ("2", "B2", None)]


def test_places_and_ranks_by_ranges(spark):
    """Numbers and ranks made range by range equal those of one window, ties, nulls and all-equal values included."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from geoladder.operators import banding

    r = random.Random(4)
    for kind in ("spread", "heavy", "equal"):
        score = lambda: None if r.random() < 0.2 else 7.0 if kind == "equal" else float(r.choice([3, 3, 3, 5, 5])) if kind == "heavy" and r.random() < 0.7 else r.random() * 9  # noqa: B023, E731
        df = spark.createDataFrame([(i, score(), i % 2) for i in range(400)], "row_id long, score double, dim int")
        for down in (True, False) if kind == "heavy" else (True,):
            order = [F.col("score").desc_nulls_last() if down else F.col("score").asc_nulls_last(), F.col("row_id")]
            want = {x.row_id: x.n for x in df.withColumn("n", F.row_number().over(Window.orderBy(*order)) - 1).collect()}
            got = {x.row_id: x.n for x in banding.numbered(df, [("score", down), ("row_id", False)], "n", window_rows=60).collect()}
            assert got == want, (kind, down)
        some = df.where("score is not null")
        every = Window.partitionBy("dim")
        one = some.withColumn("p", 1 - (F.rank().over(every.orderBy(F.col("score").desc())) - 1).cast("double") / F.count("*").over(every))
        assert {x.row_id: x.p for x in banding.percentile_desc(some, "score", ["dim"], "p", 60).collect()} == {x.row_id: x.p for x in one.collect()}


def test_type_names_from_headers(spark):
    import struct

    import numpy as np
    from pyspark.sql import functions as F

    from geoladder.functions import columns as C
    from geoladder.functions import wkb

    two = [(wkb.POLYGON, [np.array([[0, 0], [1, 0], [1, 1], [0, 0]], float)])] * 2
    values = [wkb.point(1, 2), wkb.encode(two), struct.pack(">BIddd", 0, 1001, 1, 2, 3), struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, 1, 2), None]
    df = spark.createDataFrame([(v,) for v in values], "g binary")
    assert [x.t for x in df.select(C.type_name(F.col("g")).alias("t")).collect()] == ["Point", "MultiPolygon", "Point", "Point", None]
