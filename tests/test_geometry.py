import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselon.functions import areas, geo, grid
from tesselon.operators import geometry, shapes

SQUARE = np.array([(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)], float)
HOLE = np.array([(0.2, 0.2), (0.2, 0.4), (0.4, 0.4), (0.4, 0.2), (0.2, 0.2)], float)


def test_metrics():
    assert geo.length(np.array([(0, 0), (0, 1)], float)) == pytest.approx(110574, rel=1e-3)
    assert geo.polygon_area(SQUARE) == pytest.approx(1.2309e10, rel=1e-3)
    assert geo.polygon_area(SQUARE, [HOLE]) == pytest.approx(geo.polygon_area(SQUARE) - geo.polygon_area(HOLE))
    assert geo.ring_area(SQUARE) > 0 > geo.ring_area(SQUARE[::-1])
    assert geo.squareness([SQUARE]) == pytest.approx(1, abs=1e-3)
    a = np.linspace(0, 2 * math.pi, 60)
    assert geo.squareness([np.stack([np.cos(a), np.sin(a)], axis=1) / 100]) < 0.1
    assert geo.bearing((0, 0), (1, 0)) == pytest.approx(math.pi / 2)


def test_columns_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    lines = [rng.uniform((-170, -80), (170, 80), (n, 2)) for n in (1, 2, 3, 7)]
    rings = [np.concatenate([x, x[:1]]) for x in lines if len(x) > 2]
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in c]) for k, c in enumerate(lines + rings)], "k int, c array<struct<lon: double, lat: double>>")
    for r in df.select("k", geo.length_column(F.col("c")).alias("l"), geo.polygon_area_column(F.col("c")).alias("a")).collect():
        c = (lines + rings)[r.k]
        assert r.l == pytest.approx(geo.length(c), rel=1e-9, abs=1e-9)
        assert r.a == pytest.approx(geo.polygon_area(c), rel=1e-9, abs=1e-6)


def test_inside_and_boxes():
    p = np.array([(0.5, 0.5), (0.3, 0.3), (2, 2), (0, 0.5), (1, 1)], float)
    assert geo.inside(p, [SQUARE]).tolist() == [True, True, False, True, True]
    assert geo.inside(p[:2], [SQUARE, HOLE]).tolist() == [True, False]
    assert geo.box_in_polygon((0.5, 0.5, 0.6, 0.6), [SQUARE]) and not geo.box_in_polygon((0.5, 0.5, 1.6, 0.6), [SQUARE])
    assert geo.box_outside_polygon((2, 2, 3, 3), [SQUARE]) and not geo.box_outside_polygon((-1, -1, 3, 3), [SQUARE])


def test_clipping():
    parts = geo.clip_line(np.array([(-1, 0.5), (2, 0.5), (2, 2), (0.5, 2), (0.5, 0.7)], float), (0, 0, 1, 1))
    assert [p.tolist() for p in parts] == [[[0, 0.5], [1, 0.5]], [[0.5, 1], [0.5, 0.7]]]
    assert geo.clip_line(np.array([(5, 5), (6, 6)], float), (0, 0, 1, 1)) == []
    assert abs(geo.ring_area(geo.clip_ring(SQUARE, SQUARE + 0.5))) == pytest.approx(abs(geo.ring_area(SQUARE / 2 + 0.5)), rel=1e-3)
    assert len(geo.clip_ring(SQUARE, SQUARE + 5)) == 0


def test_assembly():
    two = geometry.assemble([SQUARE[:3], SQUARE[2:][::-1], SQUARE + 10], [HOLE, HOLE + 10, HOLE + 50])
    assert len(two) == 2 and sorted(len(h) for _, h in two) == [1, 1]
    one = geometry.assemble([SQUARE], [HOLE, HOLE + 50])
    assert len(one) == 1 and len(one[0][1]) == 2  # with one outer ring all inners are its holes
    assert geometry.assemble([SQUARE[:3]], []) == []
    touching = [HOLE, HOLE + (0.2, 0.0)]
    assert len(geometry.assemble([SQUARE], touching)[0][1]) == 1
    pinched = np.array([(0, 0), (1, 0), (1, 1), (0, 0), (-1, 0), (-1, -1), (0, 0)], float)
    assert len(geometry.join_rings([pinched])) == 2


def test_shapes_of_relations():
    part = lambda pos, role, line, area=False: {"pos": pos, "role": role, "area": area, "coords": [{"lon": float(x), "lat": float(y)} for x, y in line]}
    whole = shapes.relation_shape(True, [part(0, "outer", SQUARE), part(1, "inner", HOLE), part(2, "", [(3, 3)])])
    assert whole["kind"] == "polygon" and [len(p) for p in whole["polygons"]] == [2]
    assert shapes.relation_shape(True, [part(0, "outer", SQUARE[:3])])["kind"] == "other"
    route = shapes.relation_shape(False, [part(0, "outer", SQUARE, True), part(1, "", SQUARE), part(2, "", [(3, 3)])])
    assert route["kind"] == "other" and [len(route[k]) for k in ("polygons", "lines", "points")] == [1, 1, 1]
    assert shapes.relation_shape(False, [])["kind"] is None


@pytest.mark.parametrize("tags,area", [({"building": "yes"}, True), ({"building": "no"}, False), ({"building": "yes", "area": "no"}, False), ({"highway": "services"}, True), ({"highway": "primary"}, False), ({"highway": "no"}, True), ({"natural": "cliff"}, False), ({"natural": "wood"}, True), ({"area": "yes"}, True), ({}, False)])
def test_area_rules(spark, tags, area):
    assert areas.way_is_area(tags) is area
    df = spark.createDataFrame([(tags,)], "tags map<string,string>")
    assert df.select(areas.way_is_area_column(F.col("tags"))).first()[0] is area


def test_way_geometry(spark):
    tags, c = F.col("tags"), F.col("c")
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [({"building": "yes"}, ring), ({"highway": "primary"}, ring), ({"building": "yes"}, ring[:3]), ({}, ring[:1]), ({}, [])]
    df = spark.createDataFrame(rows, "tags map<string,string>, c array<struct<lon: double, lat: double>>")
    assert [r[0] for r in df.select(geometry.way_geometry_column(c, tags)).collect()] == ["polygon", "line", "line", "point", None]


def test_grid():
    assert grid.cell_id(0, 0, 0) == 0 and grid.cell_id(1, -1, 0) == 0 and grid.cell_id(1, 0, 0) == 1
    assert grid.cell_id(2, grid.HALF, 0) == grid.cell_id(2, -grid.HALF, 0)
    assert grid.cell_id(2, 0, grid.QUARTER) == 6 and grid.cell_id(2, grid.HALF + 1, 0) == -1
    assert sum(hi - lo + 1 for lo, hi in grid.ranges(14, (-grid.HALF, -grid.QUARTER, grid.HALF, grid.QUARTER))) == 2**14 * 2**13
    assert len(grid.ranges(14, (-grid.HALF, -grid.QUARTER, grid.HALF, grid.QUARTER))) == 8192
    assert grid.ranges(2, (5, 5, 1, 1)) == []
    assert len(grid.ranges(4, (1700000000, 0, -1700000000, 10))) > 1


@settings(max_examples=200, deadline=None)
@given(st.integers(-1_799_999_999, 1_799_999_999), st.integers(-899_999_999, 899_999_999), st.integers(0, 400_000_000), st.integers(0, 300_000_000))
def test_an_entity_is_found_where_it_is_filed(lon, lat, w, h):
    box = lon, lat, min(lon + w, 1_799_999_999), min(lat + h, 899_999_999)
    level, cell = grid.insert_level(box)
    for query in (box, (box[2], box[3], box[2], box[3]), ((box[0] + box[2]) // 2, (box[1] + box[3]) // 2) * 2):
        assert any(lo <= cell <= hi for lo, hi in grid.ranges(level, query)), (box, query, level, cell)


def test_neighbours_and_boxes(spark):
    from tesselon import model

    assert grid.neighbours(5, 5 * 32 + 5) == [(4 * 32 + 4, 4 * 32 + 6), (5 * 32 + 4, 5 * 32 + 6), (6 * 32 + 4, 6 * 32 + 6)]
    assert grid.neighbours(2, 0) == [(-1, -1), (0, 1), (4, 5)]
    df = spark.createDataFrame([([(1.5, 2.0), (-1.0, 3.25)],)], "c array<struct<lon: double, lat: double>>")
    b = df.select(model.box_of(F.col("c")).alias("b")).select("b", model.ring_of(F.col("b")).alias("r"), model.is_valid(F.col("b")).alias("v"), model.is_point(F.col("b")).alias("p"), model.intersection(F.col("b"), F.col("b")).alias("i")).first()
    assert tuple(b.b) == (-10_000_000, 20_000_000, 15_000_000, 32_500_000) == tuple(b.i) and b.v and not b.p and len(b.r) == 5
