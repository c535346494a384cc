"""Registered queries over geometries of both views, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions import filters, geo
from tesselon.operators import shapes, views
from tesselon.plans import places as P

SHARE, POLAR = repr(geo.LENGTH_SHARE), repr(geo.POLAR_SHARE)
INSTANTS = ("2020-04-01", "2020-08-01")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        _queries[name], _oracles[name] = f, sql
        return f

    return add


def lengths(points: str, name: str) -> str:
    return P.lengths_sql(points, name, SHARE, geo.RADIUS_MEAN)


def areas(points: str, name: str) -> str:
    return P.areas_sql(points, name, POLAR, geo.RADIUS_EQUATOR, geo.INVERSE_FLATTENING)


def snapshots(s, d, text: str):
    return P.store(s, d).snapshots().timestamps(list(map(_instant, INSTANTS))).filter(text)


def _instant(text: str):
    from datetime import datetime

    return datetime.fromisoformat(text)


#: building: closed ways, relation: multipolygons of the same rings; open: open ways, half ways.
BUILDINGS = "o % 2 = 0 and n >= 3"
AREAS_SQL = f"""with {P.PLACES_SQL}, closed as (select * from ring where {BUILDINGS}),{areas("closed", "ar")},{lengths("closed", "per")},
shape as (
  select d, o, n, area, length as perimeter, case when length > 0 then 4 * pi() * area / (length * length) else 0 end as roundness
  from ar join per using (d, o) join good using (o)
), entity as (select *, 'way' as osm_type from shape union all select *, 'relation' from shape where n >= 4)"""

POLYGON_FILTERS = {
    "filter_geom_area": ("area:(1E8..5E8)", "area between 1e8 and 5e8"),
    "filter_geom_perimeter": ("perimeter:(1..200000)", "perimeter between 1 and 200000"),
    "filter_geom_vertices": ("geometry:polygon and geometry.vertices:(5..6)", "n between 4 and 5"),
    "filter_geom_roundness": ("geometry.roundness:(0.3..)", "roundness >= 0.3"),
    "filter_geom_rings": ("geometry.outers:1 and geometry.inners:0 and not type:way", "osm_type = 'relation'"),
    "filter_geom_not": ("geometry:polygon and not area:(1E8..5E8)", "not area between 1e8 and 5e8"),
}
for _name, (_text, _condition) in POLYGON_FILTERS.items():
    query(_name, f"{AREAS_SQL} select d as \"timestamp\", osm_type, o as osm_id from entity where {_condition}")(
        lambda s, d, text=_text: snapshots(s, d, text).rows().select(F.col("snapshot_ts").alias("timestamp"), "osm_type", "osm_id")
    )

OPEN_SQL = f"""with {P.PLACES_SQL},
open_pt as (
  select d, o, i, lon, lat from pt where not ({BUILDINGS})
  union all select d, {P.HALVES} + 2 * o, i, lon, lat from pt where o % 2 = 0 and n >= 4 and i <= 3
  union all select d, {P.HALVES} + 2 * o + 1, i, lon, lat from ring where o % 2 = 0 and n >= 4 and i >= 3
),{lengths("open_pt", "len")}"""
query("filter_geom_length", f"{OPEN_SQL} select d as \"timestamp\", o as osm_id from len where length between 20000 and 90000")(
    lambda s, d: snapshots(s, d, "length:(20000..90000)").rows().select(F.col("snapshot_ts").alias("timestamp"), "osm_id")
)
TYPES_SQL = f"""{OPEN_SQL}, k as (
  select d, 'way' as osm_type, 'line' as geometry from len
  union all select d, 'way', 'polygon' from instants, good where {BUILDINGS}
  union all select d, 'relation', 'polygon' from instants, good where o % 2 = 0 and n >= 4
  union all select d, 'node', 'point' from pt
) select d as "timestamp", osm_type, geometry, count(*) as n from k group by all"""
query("view_geometry_types", TYPES_SQL)(
    lambda s, d: (lambda b: b.rows().groupBy(F.col("snapshot_ts").alias("timestamp"), "osm_type", b.metric("geometry").alias("geometry")).agg(F.count(F.lit(1)).alias("n")))(snapshots(s, d, "").geometries())
)

# -- clipping: regions and areas of interest

REGIONS = {"southwest": (80000000, 490000000, 84000000, 494500000), "east": (84000000, 480000000, 99000000, 500000000), "northwest": (80000000, 494500000, 84000000, 500000000), "nothing": (0, 0, 1, 1)}
REGIONS_SQL = "regions as (select * from (values " + ", ".join(f"('{n}', {a / 1e7}::double, {b / 1e7}::double, {c / 1e7}::double, {e / 1e7}::double)" for n, (a, b, c, e) in REGIONS.items()) + ") t(region, a, b, c, e))"


def cut_sql(regions: str) -> str:
    """CTEs up to cut(region, d, o, length): metres of open ways in boxes, by the shares of each step that lie inside."""
    return f"""{OPEN_SQL}, {regions},
step as (
  select d, o, lon as x, lat as y, lead(lon) over w - lon as dx, lead(lat) over w - lat as dy from open_pt window w as (partition by d, o order by i)
), share as (
  select region, d, o, x, y, dx, dy,
    case when dx = 0 then case when x between a and c then 0 else 2 end else least((a - x) / dx, (c - x) / dx) end as ax,
    case when dx = 0 then 1 else greatest((a - x) / dx, (c - x) / dx) end as bx,
    case when dy = 0 then case when y between b and e then 0 else 2 end else least((b - y) / dy, (e - y) / dy) end as ay,
    case when dy = 0 then 1 else greatest((b - y) / dy, (e - y) / dy) end as by_
  from step, regions where dx is not null
), part as (select *, greatest(0, ax, ay) as t0, least(1, bx, by_) as t1 from share
), leg as (
  select region, d, o, radians((t1 - t0) * dx) as dl, atan({SHARE} * tan(radians(y + t0 * dy))) as y0, atan({SHARE} * tan(radians(y + t1 * dy))) as y1 from part where t0 < t1
), cut as (
  select region, d, o, sum(sqrt(pow(dl * cos((y0 + y1) / 2), 2) + pow(y1 - y0, 2))) * {geo.RADIUS_MEAN} as length from leg group by all
)"""


query("view_region_length", f"{cut_sql(REGIONS_SQL)} select region, d as \"timestamp\", round(coalesce(sum(length), 0), 0) as result from regions cross join instants left join cut using (region, d) group by all")(
    lambda s, d: (lambda b: b.aggregate_by_geometry(REGIONS).aggregate_by_timestamp().sum(b.metric("length")))(snapshots(s, d, "geometry:line")).withColumn("result", F.round("result", 0))
)
AREA = (82000000, 492000000, 87000000, 497000000)
AREA_SQL = f"regions as (select 'area' as region, {AREA[0] / 1e7}::double as a, {AREA[1] / 1e7}::double as b, {AREA[2] / 1e7}::double as c, {AREA[3] / 1e7}::double as e)"
query("view_aoi_length", f"{cut_sql(AREA_SQL)} select d as \"timestamp\", count(*) as n, round(sum(length), 0) as length from cut group by d")(
    lambda s, d: (lambda b: b.rows().groupBy(F.col("snapshot_ts").alias("timestamp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(b.metric("length")), 0).alias("length")))(snapshots(s, d, "geometry:line").area_of_interest(AREA).geometries())
)

# -- contributions by members

LOG = ("osm_type", "osm_id", "ts", "creation", "deletion", "tag_change", "geometry_change")


def contributions(s, d, text: str):
    return P.store(s, d).contributions().timestamps("2020-01-01", "2021-01-01").filter(text).rows().select(*LOG)


def log_sql(entities: str) -> str:
    """The log of entities(osm_type, osm_id, since): each is made once, and changed when the first node of its order moves."""
    return f"""select osm_type, osm_id, since as ts, true as creation, false as deletion, false as tag_change, false as geometry_change from ({entities})
union all select osm_type, osm_id, timestamp '{P.MOVE}', false, false, false, true from ({entities})"""


BUILDING_LOG = f"select 'way' as osm_type, o as osm_id, timestamp '{P.WAYS}' as since from good where {BUILDINGS}"
query("view_contribution_ways", f"with {P.PLACES_SQL} {log_sql(BUILDING_LOG)}")(lambda s, d: contributions(s, d, "building=yes"))
RELATION_LOG = f"select 'relation' as osm_type, o as osm_id, timestamp '{P.RELATIONS}' as since from good where o % 2 = 0 and n >= 4"
query("view_contribution_relations", f"with {P.PLACES_SQL} {log_sql(RELATION_LOG)}")(lambda s, d: contributions(s, d, "type:relation"))
# a contribution passes if the state before or after has such an area
query(
    "view_contribution_area",
    f"""{AREAS_SQL}, v as (select osm_type, o, max(area) filter (d < timestamp '{P.MOVE}') as a, max(area) filter (d >= timestamp '{P.MOVE}') as b from entity group by all)
select osm_type, o as osm_id, case osm_type when 'way' then timestamp '{P.WAYS}' else timestamp '{P.RELATIONS}' end as ts, true as creation, false as deletion, false as tag_change, false as geometry_change from v where a between 1e8 and 5e8
union all select osm_type, o, timestamp '{P.MOVE}', false, false, false, true from v where a between 1e8 and 5e8 or b between 1e8 and 5e8""",
)(lambda s, d: contributions(s, d, "area:(1E8..5E8)"))

# -- multipolygons from open ways, squareness


def relations(s, d) -> DataFrame:
    v = P.versions(s, d)
    return views.snapshots(v, list(map(_instant, INSTANTS)), filters.parse("type:relation"), v.where("osm_type <> 'relation'"), shaped=True)


query("multipolygon_assembly", f"{AREAS_SQL} select d as \"timestamp\", o as osm_id, round(area / 1000, 0) as area, round(perimeter, 1) as perimeter, 1::bigint as outers, 0::bigint as inners from entity where osm_type = 'relation'")(
    lambda s, d: relations(s, d).select(
        F.col("snapshot_ts").alias("timestamp"),
        "osm_id",
        F.round(shapes.area_of(F.col("shape")) / 1000, 0).alias("area"),
        F.round(shapes.perimeter_of(F.col("shape")), 1).alias("perimeter"),
        shapes.metric(F.col("shape"), "outers").cast("long").alias("outers"),
        shapes.metric(F.col("shape"), "inners").cast("long").alias("inners"),
    )
)
SQUARENESS_SQL = f"""with {P.PLACES_SQL}, edge as (
  select * from (
    select o, i, lon as x1, lat as y1, lead(lon) over w as x2, lead(lat) over w as y2
    from ring where d = (select min(d) from instants) and {BUILDINGS} window w as (partition by o order by i)) where x2 is not null
), center as (
  select o, sum((x1 + x2) / 2 * l) / sum(l) as cx, sum((y1 + y2) / 2 * l) / sum(l) as cy from (select *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) as l from edge) group by o
), angle as (
  select o, i as k, (atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1))) + 2 * pi()) % (2 * pi()) as g from edge
), turned as (
  select o, k, ((x1 - cx) * s * cos(g) - (y1 - cy) * sin(g)) / s + cx as u1, (x1 - cx) * s * sin(g) + (y1 - cy) * cos(g) + cy as v1,
    ((x2 - cx) * s * cos(g) - (y2 - cy) * sin(g)) / s + cx as u2, (x2 - cx) * s * sin(g) + (y2 - cy) * cos(g) + cy as v2
  from edge join (select *, cos(radians(cy)) as s from center) using (o) join angle using (o)
), grid as (
  select o, min(total) as total from (select o, k, sum(abs(radians(u2 - u1) * cos(radians(v1 + v2) / 2)) + abs(radians(v2 - v1))) as total from turned group by o, k) group by o
), straight as (select o, sum(sqrt(pow(radians(x2 - x1) * cos(radians(y1 + y2) / 2), 2) + pow(radians(y2 - y1), 2))) as total from edge group by o)
select o as osm_id, round(4 / (4 - pi()) * (straight.total / grid.total - pi() / 4), 6) as squareness from grid join straight using (o)"""
query("geo_squareness", SQUARENESS_SQL)(
    lambda s, d: (lambda b: b.rows().select("osm_id", F.round(b.metric("squareness"), 6).alias("squareness")))(P.store(s, d).snapshots().timestamps("2020-04-01").filter("building=yes").geometries())
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracles() -> dict[str, str]:
    return dict(_oracles)
