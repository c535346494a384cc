import os
import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tesselon import model
from tesselon.operators import views
from tesselon.sources import connect, osh_pbf, osm_xml, store
from tesselon.streaming import ingest

XML = """<osm><node id="1" version="1" visible="true" timestamp="2020-01-01T00:00:00Z" uid="5" changeset="7" lon="8.12345678" lat="49.5"><tag k="a" v="b"/></node>
<node id="1" version="2" visible="false" timestamp="2020-02-01T00:00:00Z" uid="5" changeset="8"/>
<way id="2" version="1" timestamp="2020-01-01T00:00:00Z" uid="5" changeset="7"><nd ref="1"/><nd ref="3"/></way>
<relation id="4" version="1" timestamp="2020-01-01T00:00:00Z" uid="5" changeset="7"><member type="way" ref="2" role="outer"/></relation></osm>"""


def test_xml(spark, tmp_path):
    (tmp_path / "a.osm").write_text(XML)
    rows = {(r.osm_type, r.version): r for r in osm_xml.read_osm_xml(spark, str(tmp_path)).collect()}
    assert len(rows) == 4
    assert rows["node", 1].lon_e7 == 81234568 and rows["node", 1].tags == {"a": "b"} and not rows["node", 2].visible and rows["node", 2].lon_e7 is None
    assert [m.id for m in rows["way", 1].members] == [1, 3] and rows["relation", 1].members[0].role == "outer"


def varint(x):
    out = b""
    while True:
        out += bytes([x & 0x7F | (0x80 if x > 0x7F else 0)])
        x >>= 7
        if not x:
            return out


zig = lambda x: (x << 1) ^ (x >> 63)
number = lambda k, x: varint(k << 3) + varint(x)
data = lambda k, b: varint(k << 3 | 2) + varint(len(b)) + b
pack = lambda xs: b"".join(varint(x) for x in xs)


def delta(xs):
    return pack([zig(b - a) for a, b in zip([0, *xs], xs, strict=False)])


def blob(block, compressed):
    body = data(3, zlib.compress(block)) if compressed else data(1, block)
    head = data(1, b"OSMData") + number(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def test_pbf_in_ranges(spark, tmp_path):
    path = tmp_path / "h.osh.pbf"
    out = b""
    for k in range(40):
        strings = data(1, b"".join(data(1, x) for x in (b"", b"key", b"v%d" % k, b"outer")))
        info = data(1, pack([1, 2])) + data(2, delta([1000, 2000])) + data(3, delta([5, 6])) + data(4, delta([7, 7])) + data(5, delta([0, 0])) + data(6, pack([1, 0]))
        dense = data(1, delta([k, k])) + data(5, info) + data(8, delta([490000000, 490000000])) + data(9, delta([80000000 + k, 80000000])) + data(10, pack([1, 2, 0, 0]))
        meta = number(1, 3) + number(2, 1500) + number(3, 9) + number(4, 8)
        way = number(1, 100 + k) + data(2, pack([1])) + data(3, pack([2])) + data(4, meta) + data(8, delta([k, 3]))
        rel = number(1, 200 + k) + data(4, meta) + data(8, pack([3])) + data(9, delta([100 + k])) + data(10, pack([1]))
        out += blob(strings + data(2, data(2, dense)) + data(2, data(3, way)) + data(2, data(4, rel)), k % 2)
    path.write_bytes(out)
    spark.dataSource.register(osh_pbf.PbfSource)
    for split in (97, 1000, 1 << 20):
        df = spark.read.format("osh_pbf").option("split", str(split)).load(str(path))
        rows = df.collect()
        assert len(rows) == 160 and len({(r.osm_type, r.osm_id, r.version) for r in rows}) == 160
    node = next(r for r in rows if r.osm_type == "node" and r.osm_id == 3 and r.version == 1)
    assert node.lon_e7 == 80000003 and node.tags == {"key": "v3"} and node.ts == datetime(1970, 1, 1, 0, 16, 40) and node.user_id == 7
    assert not next(r for r in rows if r.osm_type == "node" and r.version == 2).visible
    assert next(r for r in rows if r.osm_id == 203).members[0].role == "outer"


def test_store_prunes(spark, tmp_path):
    rows = [("node", k, 1, True, datetime(2020, 1, 1), 1, 1, {"a": "b"}, k * 10_000_000 - 1_500_000_000, 0, None) for k in range(300)]
    table = store.histories(spark.createDataFrame(rows, model.VERSIONS))
    path = str(tmp_path / "versions")
    store.write_store(table, path)
    near = store.read_store(spark, path, (0, -100, 30_000_000, 100))
    assert sorted(r.lon_e7 for r in near.collect()) == [0, 10_000_000, 20_000_000, 30_000_000]
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    near = near.select("*")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "level" in plan.split("PartitionFilters")[1][:200] and "cell_id" in plan.split("PushedFilters")[1][:4000]
    opened = store.open_store(spark, str(tmp_path))
    assert opened.snapshots().timestamps("2020-01-02").filter("type:node and a=b").count().first().result == 300
    assert opened.metadata_value("x") is None
    with pytest.raises(FileNotFoundError):
        store.open_store(spark, str(tmp_path), "none")


def test_properties_and_arguments(spark, tmp_path):
    props = connect.properties("# c\nroot = /a\nstore: ${root}/b\nprefix=p\n")
    assert props["store"] == "/a/b"
    (tmp_path / "p").write_text("store=/x\nprefix=y")
    assert connect.arguments(["--props", str(tmp_path / "p"), "--store", "/z"]) == {"store": "/z", "prefix": "y"}
    with pytest.raises(ValueError):
        connect.connect(spark, {}, lambda s: s)


def test_stream_into_a_store(spark, tmp_path):
    rows = [("node", k, 1, k % 2 == 0, datetime(2020, 1, 1 + k), 1, 1, {"a": "b"}, 1, 1, None) for k in range(6)]
    df = spark.createDataFrame(rows, model.VERSIONS)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.where("osm_id < 4").write.parquet(source)
    for _ in range(2):
        ingest.append_to(ingest.version_stream(spark, source), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    df.where("osm_id >= 4").write.mode("append").parquet(source)
    ingest.append_to(ingest.version_stream(spark, source), out, str(tmp_path / "cp")).awaitTermination()
    assert views.snapshots(spark.read.parquet(out), [datetime(2021, 1, 1)]).count() == 3
    q = ingest.edits_by_window(ingest.version_stream(spark, source)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("edits"), F.sum("deletions")).first()[:] == (6, 3)
    assert os.path.isdir(out)


def test_rows_of_a_database(spark):
    from tesselon.sources import jdbc

    rows = spark.createDataFrame([("way", 1, 1, True, datetime(2020, 1, 1), 2, 3, None, None, '{"a": "b"}', '[{"type": "node", "id": 5, "role": ""}]')], "osm_type string, osm_id long, version int, visible boolean, ts timestamp_ntz, changeset_id long, user_id int, lon_e7 int, lat_e7 int, tags string, members string")
    r = jdbc.from_text(rows).first()
    assert r.tags == {"a": "b"} and r.members[0].id == 5


def test_translator_of_tags(spark):
    from tesselon.sources.tags import TagTranslator

    rows = [("node", 1, 1, True, datetime(2020, 1, 1), 1, 1, {"a": "b", "c": "d"}, 1, 1, None)]
    t = TagTranslator(spark.createDataFrame(rows, model.VERSIONS))
    assert t.key("a") == "a" and t.tag("a", "b") == ("a", "b") and t.role("outer") == "outer"
    assert t.keys(["a"]) == {"a": "a"} and t.tags([("a", "b")]) == {("a", "b"): ("a", "b")} and t.roles(["x"]) == {"x": "x"}
    assert t.in_use(["a", "x"], [("a", "b"), ("a", "c"), ("x", "y")]) == ({"a"}, {("a", "b")})
    assert t.in_use() == (set(), set())
    with pytest.raises(ValueError):
        TagTranslator().in_use(["a"])
