"""Whole batches against the code for one shape, what filters keep from being read, and one lookup for each version."""

import numpy as np
import pyarrow as pa
import pytest

from tesselon.functions import geo
from tesselon.functions.filters import parse
from tesselon.operators import shapes
from tesselon.plans import places, shapes_registry

BOX = (8.2, 49.2, 8.7, 49.7)


def pairs(line):
    return [{"lon": float(x), "lat": float(y)} for x, y in line]


def test_a_corner_is_crossed_where_the_shares_of_a_step_say_so():
    """Beside a corner, shares may differ by less than places do: such a line counts in SQL, whose rule is t0 < t1."""
    found = 0
    for i in range(1, 60):
        for j in range(1, 20):
            for m in range(1, 4):  # through the upper left corner, from the lower left
                x = np.array([(82_000_000 - i * 10_000) / 1e7, (82_000_000 + m * i * 10_000) / 1e7])
                y = np.array([(497_000_000 - j * 100_000) / 1e7, (497_000_000 + m * j * 100_000) / 1e7])
                t0, t1 = geo.box_shares(x[:1], y[:1], np.diff(x), np.diff(y), BOX)
                parts = geo.clip_lines(x, y, np.zeros(2, int), BOX)
                assert len(parts[2]) == int(t0[0] < t1[0])
                found += len(parts[2]) and not geo.clip_line(np.stack([x, y], axis=1), BOX)
    assert found


def test_lines_in_a_box_at_once():
    rng = np.random.default_rng(1)
    lines = [rng.uniform((7.8, 48.8), (9.1, 50.1), (rng.integers(2, 7), 2)) for _ in range(300)]
    of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    x, y = np.concatenate(lines).T
    xs, ys, sizes, line = geo.clip_lines(x, y, of, BOX)
    got = list(zip(line.tolist(), np.split(np.stack([xs, ys], axis=1), np.cumsum(sizes)[:-1]), strict=True))
    want = [(k, p) for k, one in enumerate(lines) for p in geo.clip_line(one, BOX)]
    assert [k for k, _ in got] == [k for k, _ in want]
    assert all(np.allclose(a, b) for (_, a), (_, b) in zip(got, want, strict=True))


def test_batches_of_shapes_are_cut_like_single_ones():
    rng = np.random.default_rng(2)
    some = lambda n: rng.uniform((7.8, 48.8), (9.1, 50.1), (n, 2))
    ring = np.array([(8.1, 49.3), (8.1, 49.5), (8.4, 49.5), (8.4, 49.3), (8.1, 49.3)])
    values = [None, {"kind": None, "points": [], "lines": [], "polygons": []}]
    for _ in range(100):
        values.append({"kind": "line", "points": [], "lines": [pairs(some(4))], "polygons": []})
        values.append({"kind": "point", "points": pairs(some(1)), "lines": [], "polygons": []})
        values.append({"kind": "other", "points": pairs(some(2)), "lines": [pairs(some(3)), pairs(some(2))], "polygons": [[pairs(ring)]]})
    batch = pa.array(values, shapes._ARROW)
    for rings, box in (([np.array([(8.2, 49.2), (8.2, 49.7), (8.7, 49.7), (8.7, 49.2), (8.2, 49.2)])], True), ([ring + 0.1], False)):
        for part in (batch, batch.slice(3, 50)):
            got, want = shapes.clip_array(part, rings, box).to_pylist(), shapes.clip_shapes(part.to_pylist(), rings, box)
            assert [x is None for x in got] == [x is None or x["kind"] is None for x in want]
            size = lambda s: [len(p) for p in s["lines"]]
            for a, b in zip(got, want, strict=True):
                if a is not None:
                    assert a["points"] == b["points"] and a["polygons"] == b["polygons"] and size(a) == size(b)
                    assert all(np.allclose(shapes._pairs(p), shapes._pairs(q)) for p, q in zip(a["lines"], b["lines"], strict=True))


def test_relations_of_a_batch_are_built_like_single_ones():
    square = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
    hole = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
    relations = [
        (True, [("outer", False, square[:3]), ("", False, square[2:][::-1]), ("inner", False, hole)]),
        (True, [("outer", False, square[:3])]),
        (False, [("outer", True, square), ("", False, square), ("stop", False, [(3, 3)])]),
        (True, []),
    ]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("role", pa.string()), ("area", pa.bool_()), ("lon", pa.float64()), ("lat", pa.float64())]))
    flat = [[{"pos": k, "role": role, "area": a, "lon": float(x), "lat": float(y)} for k, (role, a, c) in enumerate(parts) for x, y in c] for _, parts in relations]
    got = shapes.relation_shapes([a for a, _ in relations], pa.array([*flat[:3], None], kind)).to_pylist()
    want = [shapes.relation_shape(a, [{"pos": k, "role": role, "area": x, "coords": pairs(c)} for k, (role, x, c) in enumerate(parts)]) for a, parts in relations]
    assert got == want


def test_squareness_of_many():
    rng = np.random.default_rng(3)
    lines = rng.uniform((8, 49), (9, 50), (50, 6, 2))
    lines[0] = lines[0, :1]  # one place, over and over
    assert np.allclose(geo.squareness_of_many(lines), [geo.squareness([x]) for x in lines])
    value = lambda parts, polygons=(): {"kind": "line", "points": [], "lines": [pairs(x) for x in parts], "polygons": [[pairs(r) for r in p] for p in polygons]}
    batch = [value([lines[1]]), None, value([], [[lines[2]]]), value([lines[3], lines[4][:3]]), value([])]
    want = [geo.squareness([lines[1]]), 0, geo.squareness([lines[2]]), geo.squareness([lines[3], lines[4][:3]]), 0]
    assert np.allclose(shapes.squareness_array(pa.array(batch, shapes._ARROW)), want)


@pytest.mark.parametrize(
    "text, nodes",
    [("area:(1..5)", False), ("area:(0..5)", True), ("not area:(1..5)", True), ("not area:(..5)", False), ("geometry.vertices:(5..6)", False), ("geometry.vertices:(1..2)", True), ("geometry.outers:1", False), ("geometry.outers:(..0)", True), ("length:(20..) or type:node", True), ("perimeter:(1..)", False), ("geometry.roundness:(0.3..)", False)],
)
def test_nodes_are_not_read_where_no_metric_of_theirs_passes(text, nodes):
    assert ("node" in parse(text).types()) == nodes


def test_items_are_gathered_once(spark):
    """All readers of a projection's orders share one shuffle of the items."""
    df = shapes_registry.queries()["filter_geom_area"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("lineitem") <= 2 and "ReusedExchange" in plan or plan.count("FileScan parquet") == 1


def test_a_members_states_are_looked_up_once_for_all_times(spark):
    """The rows between nodes and ways are as many for ten times as for one."""
    from datetime import datetime, timedelta

    from tesselon.operators import views

    v = places.versions(spark, "/root/testdata/sf0.001")
    at = [datetime(2020, 4, 1) + timedelta(days=k) for k in range(10)]
    df = views.snapshots(v, at, parse("building=yes and type:way"), v.where("osm_type <> 'relation'"), shaped=True).select("osm_id", "snapshot_ts", "shape")
    few = views.snapshots(v, at[:1], parse("building=yes and type:way"), v.where("osm_type <> 'relation'"), shaped=True).select("osm_id", "snapshot_ts", "shape")

    def joined(df):
        df.collect()
        out, stack = [], [df._jdf.queryExecution().executedPlan()]
        while stack:
            p = stack.pop()
            if p.nodeName() == "AdaptiveSparkPlan":
                stack.append(p.executedPlan())
            if "QueryStage" in p.nodeName():
                stack.append(p.plan())
            if p.nodeName().endswith("Join") and p.metrics().contains("numOutputRows"):
                out.append(p.metrics().apply("numOutputRows").value())
            stack += [p.children().apply(k) for k in range(p.children().size())]
        return max(out)

    assert joined(df) == joined(few)
