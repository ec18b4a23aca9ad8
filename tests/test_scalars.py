import json
import math

import numpy as np
import pytest

from geoladder.functions import columns as C
from geoladder.functions import crs
from geoladder.options import LayoutOptions
from geoladder.plans import footer, ladder, planner


def test_zoom_and_bands():
    w = ladder.WORLD_DEGREES
    assert ladder.zoom_for_gsd(0, w) == 24 and ladder.zoom_for_gsd(w / 256, w) == 0 and ladder.zoom_for_gsd(w, w) == 0
    assert ladder.coarsest_zoom(360, 180, w) == 2
    assert ladder.most_coarse_bands(2) == 11 and ladder.most_coarse_bands(23) == 1 and ladder.most_coarse_bands(40) == 0
    assert ladder.derive_bands(0, 1, 1 / 1500, 4, 8e6) == 1
    assert ladder.derive_bands(1e12, 1, 1 / 1500, 1, 8e6) == 1
    d = 8e6 / (1024 * (1 / 1500) / 4**2.5) ** 2  # affordable two and a half steps below the first tolerance
    assert ladder.derive_bands(d, 1, 1 / 1500, 4, 8e6) == 4
    assert ladder.derive_bands(1e60, 1, 1 / 1500, 4, 8e6) == 10
    assert ladder.tolerances(3, 1500, 1 / 1500, 4) == [1.0, 0.25] and ladder.grids([1.0, 0.25]) == [0.25, 0.0625] and ladder.grids([1.0], 7) == [7]


def test_band_edges():
    assert ladder.band_edges(100, 1) == [0, 100]
    assert ladder.band_edges(100, 3, [0.1, 0.2]) == [0, 10, 30, 100]
    e = ladder.band_edges(7000, 4)
    assert e[0] == 0 and e[-1] == 7000 and e[3] == 700 and [b - a for a, b in zip(e[:3], e[1:4])] == [100, 200, 400]


def test_regime_and_bbox():
    assert ladder.regime(0, 0) == "empty" and ladder.regime(2000, 1) == "vertex" and ladder.regime(1999, 1) == "count"
    assert ladder.wants_bbox(None, "count", True) and not ladder.wants_bbox(None, "vertex", True) and ladder.wants_bbox(None, "vertex", False)
    assert ladder.wants_bbox(True, "vertex", True) and not ladder.wants_bbox(False, "count", True)


def test_zoom_ranges_tile():
    r = ladder.zoom_ranges([1.0, 1.0, 0.1], 360.0)
    assert r[0][0] == 0 and r[-1][1] == 24
    assert all(b[0] == a[1] + 1 and b[1] >= b[0] for a, b in zip(r, r[1:]))


@pytest.mark.parametrize("bad", [{"bands": -1}, {"bands": 11}, {"screen_budget_mb": 0}, {"row_group_mb": -1}, {"coarse_row_groups": 0}, {"jobs": -1}, {"overview_grid": 0.0}, {"compression_level": 0}, {"page_size_kb": 0}, {"bbox": False, "native_geo": False}])
def test_options(bad):
    with pytest.raises(ValueError):
        LayoutOptions(**bad).validate()
    assert LayoutOptions().validate().bands == 0


def test_crs():
    assert crs.authority_code("EPSG:4326") == "4326" and crs.authority_code("urn:ogc:def:crs:EPSG::3067") == "3067"
    assert crs.authority_code("OGC:CRS84") == "crs84" and crs.authority_code("CRS84h") == "crs84h" and crs.authority_code(" 4258 ") == "4258"
    assert crs.authority_code("http://www.opengis.net/def/crs/EPSG/0/4326") == "4326" and crs.authority_code("local") is None
    assert crs.is_geographic(None) and crs.is_geographic("EPSG:4326") and not crs.is_geographic("EPSG:3857") and crs.is_geographic("x", present=False)
    assert crs.is_geographic({"type": "CompoundCRS", "components": [{"type": "GeographicCRS"}]})
    assert crs.is_geographic({"type": "BoundCRS", "source_crs": {"type": "Geographic2DCRS"}}) and not crs.is_geographic({"type": "ProjectedCRS"})
    assert crs.is_geographic({"coordinate_system": {"axis": [{"unit": "degree"}]}}) and not crs.is_geographic({"coordinate_system": {"axis": [{"unit": {"name": "metre"}}]}})
    lon, lat = crs.web_mercator(np.array([20037508.342789244]), np.array([0.0]))
    assert abs(lon[0] - 180) < 1e-9 and abs(lat[0]) < 1e-9
    lon, lat = crs.tm35(np.array([500000.0, 385000.0]), np.array([7000000.0, 6672000.0]))
    assert abs(lon[0] - 27) < 1e-9 and 63 < lat[0] < 63.2 and 24.9 < lon[1] < 25.0 and 60.1 < lat[1] < 60.3
    geo = lambda c: {"primary_column": "g", "columns": {"g": {"crs": c}}}
    assert crs.of_column(None).geographic and crs.of_column(geo(None)).geographic and crs.of_column(geo({"id": {"authority": "EPSG", "code": 4326}})).geographic
    assert crs.of_column(geo({"ids": [{"authority": "EPSG", "code": 3067}]})).supported and not crs.of_column(geo({"type": "ProjectedCRS", "id": {"authority": "EPSG", "code": 2154}})).supported
    x, y = crs.to_lon_lat(np.array([np.inf, 200.0]), np.array([0.0, -95.0]), None)
    assert x.tolist() == [0.0, 180.0] and y.tolist() == [0.0, -90.0]
    corners = crs.box_to_lon_lat((300000, 6600000, 700000, 7700000), crs.tm35)
    inner = crs.tm35(np.array([500000.0]), np.array([7700000.0]))
    assert corners[3] >= inner[1][0] - 1e-9


def test_seam():
    assert C.split_at_seam((-200, -10, 200, 10)) == [(-180.0, -10.0, 180.0, 10.0)]
    assert C.split_at_seam((10, 0, 20, 5)) == [(10.0, 0.0, 20.0, 5.0)]
    assert C.split_at_seam((170, 0, 200, 5)) == [(170.0, 0.0, 180.0, 5.0), (-180.0, 0.0, -160.0, 5.0)]


def test_footer_round_trip():
    source = {"encoding": "WKB", "crs": {"x": 1}, "edges": "spherical", "covering": {"old": 1}, "epoch": 2020.5}
    geo = json.loads(footer.geo_block((0, 0, 1, 1), ["Polygon"], source, source["crs"], ["Polygon"], True))
    g, o = geo["columns"]["geometry"], geo["columns"]["geom_overview"]
    assert g["edges"] == "spherical" and g["epoch"] == 2020.5 and g["covering"] == footer.COVERING and "covering" not in o and o["crs"] == {"x": 1}
    assert "crs" not in json.loads(footer.geo_block((0, 0, 1, 1), [], source))["columns"]["geometry"]
    levels = [{"level": 1, "row_group_end": 53, "max_zoom": 10, "gsd": 0.001}, {"level": 0, "row_group_end": 19, "max_zoom": 8, "gsd": 0.005}, {"level": 2, "row_group_end": 80, "max_zoom": 24, "gsd": 0, "min_zoom": 11}]
    text = footer.overviews_block(levels, "area_desc", "simplify_snap", "count", True, True, "overview_count")
    info = footer.parse_overviews(footer.overviews_of({"overviews": text, "geo:overviews": "{}"}))
    assert [v.level for v in info.levels] == [0, 1, 2] and [v.min_zoom for v in info.levels] == [0, 9, 11] and info.own_grids and info.count_column == "overview_count"
    assert footer.parse_overviews(None) is None and footer.parse_overviews({"levels": []}) is None
    other = footer.parse_overviews({"mode": "duplicating", "levels": [{"row_group_end": 3, "zoom": 5}, {"row_group_end": 7, "zoom": 9}]})
    assert [v.row_group_start for v in other.levels] == [0, 4] and other.levels[1].max_zoom == 9 and not other.own_grids
    assert [planner.level_for_zoom(info, z).level for z in (0, 8, 9, 10, 11, 30)] == [0, 0, 1, 1, 2, 2]
    assert planner.column_for_level(info, info.levels[0]) == "geom_overview" and planner.column_for_level(info, info.levels[2]) == "geometry"
    assert planner.column_for_group(info, info.levels[1], 0) == "geometry" and planner.column_for_group(info, info.levels[1], 1) == "geom_overview" and planner.column_for_group(info, info.levels[1], None) == "geom_overview"
    assert footer.renderable(None) and not footer.renderable([]) and footer.renderable(["Polygon Z"]) and not footer.renderable(["Curve"])
    assert footer.geometry_column(["a", "geometry"], b"{broken") == "geometry" and footer.geometry_column(["g"], json.dumps({"primary_column": "g"})) == "g"
    with pytest.raises(ValueError):
        footer.geometry_column(["a"], None)
    with pytest.raises(ValueError):
        footer.check_encoding({"encoding": "point"})


def test_bands_outside_and_keys():
    info = footer.parse_overviews({"levels": [{"level": 0, "row_group_end": 0, "max_zoom": 5, "extent": [100, 0, 110, 1]}, {"level": 1, "row_group_end": 1, "max_zoom": 7, "extent": [0, 0, 10, 10]}, {"level": 2, "row_group_end": 2, "max_zoom": 24}]})
    assert planner.bands_outside(info, (1, 0, 5, 5)) == {0}
    assert planner.key_decimals(0) == 2 and planner.key_decimals(9) == 5 and planner.key_decimals(20) == 7
    assert planner.view_key("L0:g", (0.12345, 1, 2, 3), 4) == "L0:g|0.12,1.00,2.00,3.00"
    names = [n for n, _, _ in planner.viewport_ladder((0, 0, 512, 512))]
    assert names == ["full", "region", "city", "district"] and planner.viewport_ladder((0, 0, 512, 512))[3][1] == (255.5, 255.5, 256.5, 256.5)
    assert math.isclose(ladder.WORLD_METRES, 40075016.6855785)


def test_command_line():
    from geoladder.__main__ import main, parser

    a = parser().parse_args(["convert", "a", "b", "--no-thin", "--bands", "3", "--band-fractions", "0.1,0.2", "--importance-column", "w", "--no-bbox"])
    assert (a.thin, a.bands, a.band_fractions, a.importance_column, a.bbox, a.screen_budget_mb) == (False, 3, (0.1, 0.2), "w", False, 8.0)
    assert main(["-q", "convert", "a", "b", "--bands", "-1"]) == 2
