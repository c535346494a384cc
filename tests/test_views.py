"""Hand-written histories, one for each rule."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tesselon import model
from tesselon.functions.filters import parse
from tesselon.operators import members, views
from tesselon.operators.pipeline import Store, nest


def at(day: int) -> datetime:
    return datetime(2020, 1, day)


def version(osm_id, n, day, changeset=None, tags=None, visible=True, lon=10, lat=10, kind="node", refs=None, user=1):
    m = None if refs is None else [("node", r, "") for r in refs]
    return (kind, osm_id, n, visible, at(day), changeset or day, user, tags or {"a": "b"}, lon if kind == "node" and visible else None, lat if kind == "node" and visible else None, m)


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(rows, model.VERSIONS)


DAYS = [at(d) for d in range(1, 11)]


def snap(df, days=DAYS, text="", nodes=None):
    return sorted((r.snapshot_ts.day, r.osm_id, r.version) for r in views.snapshots(df, days, parse(text), nodes).collect())


def log(df, text="", days=(at(1), at(30)), nodes=None):
    kinds = ("creation", "deletion", "tag_change", "geometry_change")
    return sorted((r.osm_id, r.ts.day, tuple(k for k in kinds if r[k])) for r in views.contributions(df, list(days), parse(text), nodes).collect())


def test_newest_version_at_an_instant_inclusive(table):
    df = table(version(1, 1, 2), version(1, 2, 4), version(1, 3, 6, visible=False), version(1, 4, 9))
    assert snap(df) == [(2, 1, 1), (3, 1, 1), (4, 1, 2), (5, 1, 2), (9, 1, 4), (10, 1, 4)]


def test_ways_without_members_have_no_snapshot_but_a_contribution(table):
    df = table(version(1, 1, 2, kind="way", refs=[]), version(1, 2, 4, kind="way", refs=[1, 2]))
    assert snap(df, [at(3), at(5)]) == [(5, 1, 2)]
    assert log(df) == [(1, 2, ("creation",)), (1, 4, ("geometry_change",))]


def test_filter_decides_creation_and_deletion(table):
    df = table(version(1, 1, 1), version(1, 2, 2, tags={"x": "1"}), version(1, 3, 3, tags={"x": "2"}), version(1, 4, 4), version(1, 5, 5), version(1, 6, 6, tags={"x": "3"}))
    assert log(df, "x=*") == [(1, 2, ("creation",)), (1, 3, ("tag_change",)), (1, 4, ("deletion",)), (1, 6, ("creation",))]


def test_no_change_at_all_is_a_contribution(table):
    assert log(table(version(1, 1, 1), version(1, 2, 2), version(1, 3, 3, lon=11))) == [(1, 1, ("creation",)), (1, 2, ()), (1, 3, ("geometry_change",))]


def test_changesets_are_squashed_to_their_last_time(table):
    df = table(version(1, 1, 1, 7), version(1, 2, 2, 7, tags={"x": "1"}), version(1, 3, 3, 8), version(1, 4, 4, 7))
    assert log(df) == [(1, 2, ("creation",)), (1, 3, ("tag_change",)), (1, 4, ())]


def test_window_is_half_open_and_seeded(table):
    df = table(version(1, 1, 1), version(1, 2, 3, tags={"x": "1"}), version(1, 3, 5))
    assert log(df, days=(at(3), at(5))) == [(1, 3, ("tag_change",))]


def test_before_of_a_recreation_is_the_deleted_version(table):
    df = table(version(1, 1, 1), version(1, 2, 2, visible=False), version(1, 3, 3))
    rows = {r.ts.day: r for r in views.contributions(df, [at(1), at(9)]).collect()}
    assert rows[3].creation and rows[3].before.version == 2 and rows[2].deletion and rows[2].before.version == 1


def test_two_versions_of_one_time(table):
    df = table(version(1, 1, 2), version(1, 2, 2, tags={"x": "1"}))
    assert snap(df, [at(2)]) == [(2, 1, 2)]


def test_members_cause_contributions_while_they_are_members(table):
    nodes = table(version(1, 1, 1), version(1, 2, 4, lon=20), version(1, 3, 8, lon=30), version(2, 1, 1), version(3, 1, 1))
    ways = table(version(9, 1, 2, kind="way", refs=[1, 2]), version(9, 2, 6, kind="way", refs=[2, 3]))
    assert log(ways, nodes=nodes) == [(9, 2, ("creation",)), (9, 4, ("geometry_change",)), (9, 6, ("geometry_change",))]
    times = sorted(r.ts.day for r in members.modification_times(ways, nodes).collect())
    assert times == [2, 4, 6]
    last = {r.snapshot_ts.day: r.last_contribution_ts.day for r in views.snapshots(ways, [at(3), at(5), at(9)], None, nodes).collect()}
    assert last == {3: 2, 5: 4, 9: 6}


def test_membership_intervals_merge_adjacent_versions(table):
    ways = table(version(9, 1, 2, kind="way", refs=[1]), version(9, 2, 4, kind="way", refs=[1, 2]), version(9, 3, 6, kind="way", refs=[2]), version(9, 4, 8, kind="way", refs=[1]))
    got = sorted((r.m_id, r.since.day, r.until and r.until.day) for r in members.membership_intervals(ways).collect())
    assert got == [(1, 2, 6), (1, 8, None), (2, 4, 8)]


def test_asof_without_match_and_ties(spark):
    left = spark.createDataFrame([("a", at(1)), ("a", at(3)), ("b", at(3)), ("a", at(3))], "k string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", at(2), 1), ("a", at(3), 2), ("a", at(3), 3)], "k string, ts timestamp_ntz, version int")
    got = sorted(((r.k, r.ts.day, r.m_version) for r in members.asof_join(left, right, ["k"]).collect()), key=str)
    assert got == [("a", 1, None), ("a", 3, 3), ("a", 3, 3), ("b", 3, None)]


def test_empty_table(spark):
    df = spark.createDataFrame([], model.VERSIONS)
    assert snap(df) == [] and log(df) == []
    b = Store(df).snapshots().timestamps(DAYS)
    assert [r.result for r in b.aggregate_by_timestamp().count().collect()] == [0] * 10
    assert b.count().first().result == 0


def test_builder(table):
    df = table(version(3, 1, 1, tags={"k": "1"}), version(6, 1, 2, tags={"k": "5"}), version(6, 2, 5, tags={"k": "7"}), version(9, 1, 5, tags={"k": "x"}))
    b = Store(df).snapshots().timestamps("2020-01-01", "2020-01-07", "P3D")
    k = F.expr("try_cast(tags['k'] as int)")
    assert [(r.timestamp.day, r.result) for r in b.aggregate_by_timestamp().sum(k).collect()] == [(1, 1), (4, 6), (7, 8)]
    assert b.count().first().result == 6
    assert b.map(F.col("osm_id")).count_uniq().first().result == 3
    assert b.filter("k=x").count().first().result == 1
    assert b.map(F.lit(1)).filter("k=x").sum().first().result == 1
    two = b.aggregate_by(F.col("osm_id"), [100], "id").aggregate_by_timestamp().count().collect()
    assert len(two) == 4 * 3 and nest(two, ["id", "timestamp"])[100] == {at(1): 0, at(4): 0, at(7): 0}
    f = b.quantile_function(k)
    assert f(0.0) == 1 and f(1.0) == 7
    assert b.map(k).reduce(lambda: 0.0, lambda s, v: s + (v or 0), kind="double").first().result == 15.0
    assert b.where(F.lit(False)).map(k).reduce(lambda: 0.5, lambda s, v: s + v, kind="double").first().result == 0.5
    grouped = b.group_by_entity().rows().collect()
    assert sorted((r.osm_id, len(r.rows)) for r in grouped) == [(3, 3), (6, 2), (9, 1)]
    assert sum(1 for _ in b.stream()) == 6
    import math

    assert math.isnan(b.filter("none=*").average(k).first().result)


def test_builder_refuses(table):
    b = Store(table(version(1, 1, 1))).snapshots().timestamps(DAYS)
    for bad in (lambda: b.sum(), lambda: b.map(F.lit("x")).sum(), lambda: b.group_by_entity().group_by_entity(), lambda: b.map(F.lit(1)).aggregate_by_geometry({"a": (0, 0, 1, 1)})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="outside"):
        b.aggregate_by_timestamp(F.lit(at(20))).count().collect()
    with pytest.raises(ValueError):
        b.filter("changeset:5").count()


def test_timeout(table, spark):
    import time

    b = Store(table(version(1, 1, 1))).snapshots().timestamps(DAYS).timeout(1.0)
    with pytest.raises(TimeoutError), b.within():
        spark.range(4).repartition(4).mapInArrow(lambda batches: (time.sleep(20), *batches)[1:], "id long").collect()


def test_areas_of_interest(table):
    df = table(version(1, 1, 1, lon=5, lat=5), version(2, 1, 1, lon=50, lat=50), version(3, 1, 1, lon=-1799999999, lat=0))
    b = Store(df).snapshots().timestamps("2020-01-02")
    ids = lambda x: sorted(r.osm_id for r in x.rows().collect())
    assert ids(b.area_of_interest((0, 0, 10, 10))) == [1]
    assert ids(b.area_of_interest((0, 0, 10, 10)).area_of_interest((20, 20, 60, 60))) == []
    assert ids(b.area_of_interest((1700000000, -10, -1700000000, 10))) == [3]
    assert ids(b.area_of_interest([[(0, 0), (100, 0), (0, 100), (0, 0)]])) == [1, 2]
    assert {r.region: r.result for r in b.aggregate_by_geometry({"a": (0, 0, 100, 100), "b": [[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]], "c": (1, 1, 2, 2)}).count().collect()} == {"a": 2, "b": 1, "c": 0}


def test_moving_into_an_area_is_a_creation(table):
    df = table(version(1, 1, 1, lon=50, lat=5), version(1, 2, 2, lon=5, lat=5), version(1, 3, 3, lon=6, lat=5), version(1, 4, 4, lon=60, lat=5), version(1, 5, 5, lon=61, lat=5), version(1, 6, 6, lon=1, lat=1))
    rows = Store(df).contributions().timestamps("2020-01-01", "2020-01-20").area_of_interest((0, 0, 10, 10)).rows().collect()
    assert sorted((r.ts.day, r.creation, r.deletion, r.geometry_change) for r in rows) == [(2, True, False, False), (3, False, False, True), (4, False, True, False), (6, True, False, False)]


def test_ways_in_an_area(table):
    unit = 10_000_000
    nodes = table(version(1, 1, 1, lon=0, lat=0), version(2, 1, 1, lon=10 * unit, lat=10 * unit), version(2, 2, 5, lon=0, lat=10 * unit), version(3, 1, 1, lon=50 * unit, lat=0))
    ways = table(version(8, 1, 2, kind="way", refs=[1, 2]), version(9, 1, 2, kind="way", refs=[3, 3]))
    box = (4 * unit, 4 * unit, 6 * unit, 6 * unit)
    store = Store(ways, nodes)
    got = sorted((r.snapshot_ts.day, r.osm_id) for r in store.snapshots().timestamps([at(3), at(6)]).area_of_interest(box).rows().collect())
    assert got == [(3, 8)]
    rows = store.contributions().timestamps([at(1), at(9)]).area_of_interest(box).rows().collect()
    assert sorted((r.osm_id, r.ts.day, r.creation, r.deletion) for r in rows) == [(8, 2, True, False), (8, 5, False, True)]


def test_a_member_change_without_a_move_changes_nothing(table):
    nodes = table(version(1, 1, 1), version(1, 2, 4, tags={"x": "y"}), version(2, 1, 1))
    ways = table(version(9, 1, 2, kind="way", refs=[1, 2]))
    assert log(ways, nodes=nodes) == [(9, 2, ("creation",)), (9, 4, ())]
