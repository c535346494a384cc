import pytest
from pyspark.sql import functions as F

from tesselon.functions import filters
from tesselon.functions.filters import State, parse

ROWS = [
    ("node", 1, {"highway": "bus_stop", "name": "a b"}, None),
    ("way", 2, {"building": "yes"}, [1, 2, 3, 1]),
    ("way", 3, {"highway": "residential"}, [1, 2, 3, 4]),
    ("relation", 4, {"type": "multipolygon", "building": "no"}, [2]),
    ("relation", 5, {"type": "route"}, [3]),
]
SCHEMA = "osm_type string, osm_id long, tags map<string,string>, refs array<long>"


@pytest.fixture(scope="module")
def rows(spark):
    member = lambda x: F.struct(F.lit("node").alias("type"), x.alias("id"), F.lit("").alias("role"))
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("members", F.transform("refs", member)).cache()


@pytest.mark.parametrize(
    "text,ids",
    [
        ("", {1, 2, 3, 4, 5}),
        ("building=yes", {2}),
        ("building=*", {2, 4}),
        ("building!=yes", {1, 3, 4, 5}),
        ("building!=*", {1, 3, 5}),
        ("highway in (residential, bus_stop)", {1, 3}),
        ("not highway in (residential)", {1, 2, 4, 5}),
        ('name="a b"', {1}),
        ("type:way", {2, 3}),
        ("not type:way", {1, 4, 5}),
        ("id:3", {3}),
        ("id:way/2", {2}),
        ("id:(node/1,way/2,way/1)", {1, 2}),
        ("id:(4..2)", {2, 3, 4}),
        ("id:(..2) or id:(5..)", {1, 2, 5}),
        ("not id:(1,2)", {3, 4, 5}),
        ("geometry:polygon", {2, 4}),
        ("geometry:line", {2, 3}),
        ("geometry:other", {4, 5}),
        ("geometry:polygon and building=* and building!=no", {2}),
        ("type:node or type:way and building=yes", {1, 2}),
        ("not (type:node or building=*)", {3, 5}),
        ("not type:node and not building=*", {3, 5}),
        ("area:(1..2)", {1, 2, 3, 4, 5}),
    ],
)
def test_versions(rows, text, ids):
    assert {r.osm_id for r in rows.where(parse(text).version(State.of(rows.columns))).select("osm_id").collect()} == ids


@pytest.mark.parametrize("text", ["(", "a", "a=", "type:x", "geometry:x", "id:(", "a in ()", "a=b and", "a=b c=d", "contributor:1", "area:5", "id:(..)", "a in (b", "&"])
def test_refused(text):
    with pytest.raises(ValueError):
        parse(text)


def test_negation_twice_and_text():
    for text in ("a=b", "a in (b, c)", "id:(1..3)", "a=b and (c=* or type:node)", "not area:(1..)"):
        n = parse(text)
        assert parse(str(n)) == n
        assert str(n.negated().negated()).count("a") >= 0
    assert str(parse("not (a=b and c!=*)")) == "a!=b or c=*"


def test_normal_form_and_bounds():
    n = parse("(a=1 or a=2) and (b=1 or b=2) and type:way")
    assert len(filters.normal_form(n)) == 4
    assert n.types() == {"way"}
    assert parse("geometry:polygon and type:way or geometry:line").types() == {"way"}
    many = " and ".join(f"(k{i}=1 or k{i}=2)" for i in range(20))
    with pytest.raises(OverflowError):
        filters.normal_form(parse(many))


def test_metrics_of_a_contribution(spark):
    df = spark.createDataFrame([(1, 5.0, 50.0, False, False), (2, 5.0, 5.0, False, False), (3, None, 50.0, True, False), (4, 50.0, None, False, True)], "id int, a double, b double, creation boolean, deletion boolean")
    side = lambda c: State(F.lit("way"), F.col("id"), F.create_map(F.lit("x"), F.lit("y")), area=F.col(c))
    hit = lambda text: {r.id for r in df.where(parse(text).contribution(side("a"), side("b"), F.col("creation"), F.col("deletion"))).collect()}
    assert hit("area:(10..)") == {1, 3, 4}
    assert hit("not area:(10..)") == {2}  # for a change: neither side
    with pytest.raises(ValueError):
        parse("changeset:5").row(side("a"))
