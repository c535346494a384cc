"""Geometries in both views: shapes, metrics, clipping, regions, and what builders do with them."""

import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon import model
from tesselon.functions import geo
from tesselon.operators import shapes
from tesselon.operators.pipeline import Store
from tesselon.sources import store as files

UNIT = 10_000_000
at = lambda month: datetime(2020, month, 1)


def row(kind, osm_id, month, tags=None, place=None, refs=None, version=1, visible=True):
    lon, lat = (int(v * UNIT) for v in place) if place else (None, None)
    return (kind, osm_id, version, visible, at(month), month * 10, 1, tags or {}, lon, lat, refs)


def nodes(*ids):
    return [("node", i, "") for i in ids]


@pytest.fixture
def rows():
    """A square of 4 nodes (1 to 4, the last of which moves), a hole (5 to 8), a line, ways and relations of them."""
    corners = [(0, 0), (0, 0.4), (0.4, 0.4), (0.4, 0)]
    inner = [(0.1, 0.1), (0.1, 0.2), (0.2, 0.2), (0.2, 0.1)]
    out = [row("node", k + 1, 1, place=p) for k, p in enumerate([*corners, *inner])]
    out.append(row("node", 4, 6, place=(0.8, 0), version=2))
    out.append(row("way", 20, 2, {"building": "yes"}, refs=nodes(1, 2, 3, 4, 1)))
    out.append(row("way", 21, 2, {"highway": "path"}, refs=nodes(1, 3)))
    out.append(row("way", 22, 2, refs=nodes(1, 2, 3)))
    out.append(row("way", 23, 2, refs=nodes(1, 4, 3)))  # the other half, the other way round
    out.append(row("way", 24, 2, refs=nodes(5, 6, 7, 8, 5)))
    out.append(row("relation", 30, 3, {"type": "multipolygon"}, refs=[("way", 22, "outer"), ("way", 23, ""), ("way", 24, "inner")]))
    out.append(row("relation", 31, 3, {"type": "route"}, refs=[("way", 21, ""), ("node", 5, "stop"), ("way", 20, "")]))
    out.append(row("relation", 32, 3, {"type": "multipolygon"}, refs=[("way", 22, "outer")]))  # does not close
    return out


@pytest.fixture
def table(spark, rows):
    v = spark.createDataFrame(rows, model.VERSIONS)
    return Store(v, v.where("osm_type <> 'relation'"))


SQUARE = geo.polygon_area(np.array([(0, 0), (0, 0.4), (0.4, 0.4), (0.4, 0), (0, 0)], float))
HOLE = geo.polygon_area(np.array([(0.1, 0.1), (0.1, 0.2), (0.2, 0.2), (0.2, 0.1), (0.1, 0.1)], float))


def ids(builder):
    return sorted((r.osm_type, r.osm_id) for r in builder.rows().collect())


def test_metrics_of_every_kind(table):
    b = table.snapshots().timestamps("2020-04-01").geometries()
    got = {(r.osm_type, r.osm_id): r for r in b.rows().select("osm_type", "osm_id", *[b.metric(m).alias(m) for m in shapes.METRICS]).collect()}
    assert got["node", 1].geometry == "point" and got["node", 1].vertices == 1 and got["node", 1].area == 0 and got["node", 1].outers == -1
    way, line, area, route, open_ = (got[k] for k in (("way", 20), ("way", 21), ("relation", 30), ("relation", 31), ("relation", 32)))
    assert way.geometry == "polygon" and way.area == pytest.approx(SQUARE) and way.length == 0 and way.vertices == 5 and (way.outers, way.inners) == (1, 0)
    assert line.geometry == "line" and line.length == pytest.approx(geo.length(np.array([(0, 0), (0.4, 0.4)]))) and line.perimeter == 0 and line.roundness == 0
    assert area.geometry == "polygon" and area.area == pytest.approx(SQUARE - HOLE) and (area.outers, area.inners) == (1, 1)
    assert area.perimeter > way.perimeter > 0 and 0 < area.roundness < way.roundness < 1 and way.squareness == pytest.approx(1, abs=1e-3)
    assert route.geometry == "other" and route.length == pytest.approx(line.length) and route.area == pytest.approx(way.area) and route.vertices == 8
    assert open_.geometry == "other"


def test_filters_over_both_views(table):
    snap = table.snapshots().timestamps("2020-04-01")
    assert ids(snap.filter("area:(1..)")) == [("relation", 30), ("relation", 31), ("way", 20)]
    assert ids(snap.filter("geometry:line")) == [("way", k) for k in (21, 22, 23, 24)]
    assert ids(snap.filter("geometry:polygon and geometry.inners:1")) == [("relation", 30)]
    assert ids(snap.filter("type:way and not length:(1..)")) == [("way", 20)]
    log = table.contributions().timestamps("2020-01-01", "2021-01-01").filter("area:(1..) and type:way")
    assert [(r.ts.month, r.creation, r.geometry_change) for r in log.rows().orderBy("ts").collect()] == [(2, True, False), (6, False, True)]
    # judged by the state before or after: it grows beyond the bound when its node moves
    grown = table.contributions().timestamps("2020-01-01", "2021-01-01").filter(f"type:way and area:({SQUARE * 1.2}..)")
    assert [(r.osm_id, r.ts.month) for r in grown.rows().collect()] == [(20, 6)]


def test_relations_change_with_the_nodes_of_their_ways(table):
    log = table.contributions().timestamps("2020-01-01", "2021-01-01").filter("type:relation").rows()
    got = sorted((r.osm_id, r.ts.month, r.creation, r.geometry_change) for r in log.collect())
    assert got == [(30, 3, True, False), (30, 6, False, True), (31, 3, True, False), (31, 6, False, True), (32, 3, True, False)]


def test_other_area_rules(table):
    rules = shapes.AreaRules(way_is_area=lambda tags: F.lit(False), relation_is_area=lambda tags: F.lit(False))
    b = table.snapshots().timestamps("2020-04-01").area_rules(rules).geometries()
    assert {r.g for r in b.rows().where("osm_type <> 'node'").select(b.metric("geometry").alias("g")).collect()} == {"line", "other"}


def boxes(*edges):
    return tuple(int(e * UNIT) for e in edges)


def test_regions_cut_and_add_up(table):
    regions = {f"{x}{y}": boxes(0.2 * x, 0.2 * y, 0.2 * x + 0.2, 0.2 * y + 0.2) for x in (0, 1) for y in (0, 1)}
    regions["far"] = boxes(10, 10, 11, 11)
    regions["triangle"] = [[(0, 0), (0, 4_000_000), (4_000_000, 4_000_000), (0, 0)]]
    for kind, what, whole in (("way/20", "area", SQUARE), ("way/21", "length", geo.length(np.array([(0, 0), (0.4, 0.4)]))), ("relation/30", "area", SQUARE - HOLE)):
        b = table.snapshots().timestamps("2020-04-01").filter(f"id:{kind}").aggregate_by_geometry(regions)
        got = {r.region: r.result for r in b.sum(b.metric(what)).collect()}
        assert sum(got[k] for k in ("00", "01", "10", "11")) == pytest.approx(whole, rel=1e-4) and got["far"] == 0
        if what == "area":
            assert got["triangle"] == pytest.approx(whole / 2, rel=2e-3)


def test_four_ways_count_for_the_globe(table):
    globe = {"globe": (-180 * UNIT, -90 * UNIT, 180 * UNIT, 90 * UNIT)}
    got = table.snapshots().timestamps("2020-04-01").filter("type:way").aggregate_by_geometry(globe).count().collect()
    assert [(r.region, r.result) for r in got] == [("globe", 5)]
    log = table.contributions().timestamps("2020-01-01", "2020-04-01").filter("type:way").aggregate_by_geometry(globe).count().collect()
    assert [(r.region, r.result) for r in log] == [("globe", 5)]


def test_area_of_interest_clips(table):
    box = boxes(0.3, -0.1, 0.9, 0.1)
    b = table.snapshots().timestamps("2020-04-01").area_of_interest(box).geometries()
    got = {(r.osm_type, r.osm_id): r for r in b.rows().withColumn("area", b.metric("area")).withColumn("full", shapes.area_of(F.col("full_shape"))).collect()}
    assert ("way", 21) not in got and ("node", 1) not in got and ("node", 4) in got
    assert 0 < got["way", 20].area < got["way", 20].full == pytest.approx(SQUARE)
    # a polygon that a line crosses without a node in it
    band = [[(1_000_000, -10), (3_000_000, -10), (3_000_000, 9_000_000), (1_000_000, 9_000_000), (1_000_000, -10)]]
    assert ("way", 21) in ids(table.snapshots().timestamps("2020-04-01").area_of_interest(band).filter("type:way"))
    # moving in is a creation
    log = table.contributions().timestamps("2020-01-01", "2021-01-01").filter("id:way/20").area_of_interest(boxes(0.5, -0.1, 0.9, 0.1)).rows().collect()
    assert [(r.ts.month, r.creation) for r in log] == [(6, True)]


def test_scans_are_pruned_by_the_area_of_interest(spark, rows, tmp_path):
    extra = [row("node", 1000 + k, 1, place=(-170 + k, 10)) for k in range(300)]
    v = spark.createDataFrame(rows + extra, model.VERSIONS)
    files.write_store(files.histories(v, v), str(tmp_path / "versions"))
    opened = files.open_store(spark, str(tmp_path))
    b = opened.snapshots().timestamps("2020-04-01").area_of_interest(boxes(-0.1, -0.1, 0.5, 0.5))
    assert ids(b) == sorted([*(("node", k) for k in range(1, 9)), *(("relation", k) for k in (30, 31, 32)), *(("way", k) for k in range(20, 25))])
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    text = b.rows()._jdf.queryExecution().executedPlan().toString()
    assert any("cell_id" in part[:6000] for part in text.split("PushedFilters")[1:])


def test_polygons_meet():
    square = lambda x, y, s: np.array([(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)], float)
    planar = lambda ps: sum(sum(abs((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2 * (1 if k == 0 else -1) for k, r in enumerate(p)) for p in ps)
    cases = [([square(0, 0, 1)], [square(0.5, 0.5, 1)], 0.25), ([square(0, 0, 1)], [square(0, 0, 1)], 1), ([square(0.25, 0.25, 0.5)], [square(0, 0, 1)], 0.25), ([square(0, 0, 1)], [square(1, 0, 1)], 0), ([square(0, 0, 1)], [square(0.5, 0, 1)], 0.5), ([square(0, 0, 1)], [square(5, 0, 1)], 0), ([square(0, 0, 1), square(0.25, 0.25, 0.5)], [square(0, 0, 0.5)], 0.1875), ([square(0, 0, 1), square(0.25, 0.25, 0.5)], [square(-1, -1, 3)], 0.75)]
    for a, b, want in cases:
        assert planar(geo.polygon_in_polygon(a, b)) == pytest.approx(want)
    rng = np.random.default_rng(1)
    points = rng.uniform(-1.2, 1.2, (20_000, 2))

    def star(center):
        angle = np.linspace(0, 2 * np.pi, rng.integers(5, 12), endpoint=False) + rng.uniform(0, 0.3)
        radius = rng.uniform(0.2, 1, len(angle))
        p = np.stack([center[0] + radius * np.cos(angle), center[1] + radius * np.sin(angle)], 1)
        return np.concatenate([p, p[:1]])

    for _ in range(80):
        a, b = [star((0, 0))], [star(rng.uniform(-0.5, 0.5, 2))]
        assert planar(geo.polygon_in_polygon(a, b)) == pytest.approx((geo.inside(points, a) & geo.inside(points, b)).mean() * 2.4**2, abs=0.06)


# -- what builders keep and fill


def test_maps_stay_in_grouped_and_python_rows(table):
    grouped = table.snapshots().timestamps("2020-04-01", "2020-05-01").filter("building=*").group_by_entity()
    (r,) = grouped.rows().collect()
    assert [x.tags for x in r.rows] == [{"building": "yes"}] * 2
    got = table.contributions().timestamps("2020-01-01", "2021-01-01").filter("building=*").map_python(lambda x: x["after"]["tags"]["building"] + str(x["osm_id"]), "string").rows()
    assert {r.value for r in got.collect()} == {"yes20"}


def test_reduce_fills_declared_keys(table):
    b = table.snapshots().timestamps("2020-01-15", "2020-02-15", "P1M").filter("type:way").map(F.lit(1.0)).aggregate_by_timestamp()
    assert [r.result for r in b.reduce(lambda: 0.0, lambda a, x: a + x).collect()] == [0.0, 5.0]


def test_several_keys_take_one_scan(spark, table, tmp_path):
    table.versions.write.parquet(str(tmp_path / "v"))
    stored = Store(spark.read.parquet(str(tmp_path / "v")))
    b = stored.snapshots().timestamps("2020-04-01").aggregate_by_timestamp().aggregate_by(F.col("osm_type"), ["other"], "osm_type").aggregate_by(F.col("tags")["building"], name="building")
    df = b.count()
    assert {(r.osm_type, r.building): r.result for r in df.collect()}[("way", "yes")] == 1
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 2 and len({x.split("]")[0] for x in final.split("HashAggregate(keys=[")[1:]}) > 1


def test_timeouts_hold_for_terminals(table):
    slow = table.snapshots().timestamps("2020-04-01").map_python(lambda x: time.sleep(5) or 1, "int")
    with pytest.raises(TimeoutError):
        slow.timeout(1).sum()
    quick = table.snapshots().timestamps("2020-04-01").timeout(120).count()
    assert quick.first().result == 16


def test_sketched_quantiles(table):
    b = table.snapshots().timestamps("2020-04-01").map(F.col("osm_id"))
    assert b.quantile(0.5, exact=False).first().result in range(1, 33)
    assert len(b.quantiles([0.1, 0.9], exact=False).first().result) == 2
