"""Registered queries of the engine over the projection, each with its DuckDB oracle."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions import filters, geo, grid, timeline
from tesselon.operators import geometry, members, views
from tesselon.plans import projection as P
from tesselon.plans import shapes_registry
from tesselon.sources import store

FIRST, LAST = "2024-01-01", "2024-01-31"  # the whole events table
WEEKS_SQL = "days as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-29', interval 7 day)) as d)"
DAYS_SQL = "days as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) as d)"
LENGTH_SHARE = repr(geo.LENGTH_SHARE)

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        _queries[name] = f
        if sql is not None:
            _oracles[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries | shapes_registry.queries()


def oracles() -> dict[str, str]:
    return _oracles | shapes_registry.oracles()


def rounded(df: DataFrame, name: str = "result", places: int = 4) -> DataFrame:
    """Doubles rounded, NaN as null: for comparing results only."""
    x = F.col(name).cast("double")
    return df.withColumn(name, F.when(~F.isnan(x), F.round(x, places)))


# -- snapshots


def snapshots(s, d, text: str = "", period: str = "P7D"):
    return P.store(s, d).snapshots().timestamps(FIRST, LAST, period).filter(text)


def snapshot_sql(condition: str = "true", result: str = "count(osm_id)", days: str = WEEKS_SQL) -> str:
    return f"""with {P.VERSIONS_SQL}, {days},
rows as (select d, v.* from days join v on ts <= d and (valid_to is null or d < valid_to) where visible and ({condition}))
select d as "timestamp", {result} as result from days left join rows using (d) group by d"""


query("snapshot_count_by_day", snapshot_sql(days=DAYS_SQL))(lambda s, d: snapshots(s, d, period="daily").aggregate_by_timestamp().count())
query("snapshot_last_contribution", snapshot_sql(result="max(ts)"))(lambda s, d: snapshots(s, d).aggregate_by_timestamp().aggregate(lambda _: F.max("last_contribution_ts"), None))
query(
    "snapshot_rows",
    f"""with {P.VERSIONS_SQL}, {WEEKS_SQL} select d as snapshot_ts, osm_type, osm_id, version, kind, lon_e7::int as lon_e7, lat_e7::int as lat_e7, ts as last_contribution_ts
from days join v on ts <= d and (valid_to is null or d < valid_to) where visible""",
)(lambda s, d: snapshots(s, d).rows().select("snapshot_ts", "osm_type", "osm_id", F.col("version").cast("long").alias("version"), F.col("tags")["kind"].alias("kind"), "lon_e7", "lat_e7", "last_contribution_ts"))

# -- contributions


def contributions(s, d, text: str = "", period: str = "P1D", first: str = FIRST, last: str = LAST, allow: bool = True):
    return P.store(s, d).contributions().timestamps(first, last, period).filter(filters.parse(text, allow))


def log_sql(condition: str = "true", types: str = "true") -> str:
    """CTEs up to ct, the whole log."""
    w = "window w as (partition by osm_type, osm_id order by ts)"
    return f"""with {P.VERSIONS_SQL},
st as (select *, visible and ({condition}) as alive from v where {types}),
fold as (select * from (select *, coalesce(lag(alive) over w, false) as was from st {w}) where alive or was),
sq as (select * from (select *, lead(changeset_id) over w as nx from fold {w}) where nx is null or nx <> changeset_id),
em as (select *, coalesce(lag(alive) over w, false) as before_alive, lag(kind) over w as b_kind, lag(k) over w as b_k, lag(version) over w as b_version,
  lag(lon_e7) over w as b_lon, lag(lat_e7) over w as b_lat from sq {w}),
ct as (select *, alive and not before_alive as creation, not alive as deletion,
  alive and before_alive and (b_kind is distinct from kind or b_k is distinct from k) as tag_change,
  alive and before_alive and (b_lon is distinct from lon_e7 or b_lat is distinct from lat_e7) as geometry_change
  from em where alive or before_alive)"""


WINDOW = "ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'"
BY_DAY = f"""select d as "timestamp", count(osm_id) as result from (select d from days where d < timestamp '2024-01-31') left join
(select *, date_trunc('day', ts) as d from ct where {WINDOW}) using (d) group by d"""

query("contribution_count_by_day", f"{log_sql()}, {DAYS_SQL} {BY_DAY}")(lambda s, d: contributions(s, d).aggregate_by_timestamp().count())
LOG_COLUMNS = "osm_type, osm_id, ts, creation, deletion, tag_change, geometry_change, b_version as before_version, version as after_version"


def log(df: DataFrame) -> DataFrame:
    return df.select("osm_type", "osm_id", "ts", "creation", "deletion", "tag_change", "geometry_change", F.col("before.version").cast("long").alias("before_version"), F.col("after.version").cast("long").alias("after_version"))


query("contribution_types", f"{log_sql()} select {LOG_COLUMNS} from ct where {WINDOW}")(lambda s, d: log(contributions(s, d).rows()))
query("contribution_filtered", f"{log_sql("kind in ('view', 'click')")} select {LOG_COLUMNS} from ct where {WINDOW}")(lambda s, d: log(contributions(s, d, "kind in (view, click)").rows()))
query("contribution_squash", f"{log_sql()} select osm_type, osm_id, changeset_id, ts from sq")(lambda s, d: views.squashed(_folded(P.versions(s, d))).select("osm_type", "osm_id", "changeset_id", "ts"))
query("contribution_window_seed", f"{log_sql()} select {LOG_COLUMNS} from ct where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'")(lambda s, d: log(contributions(s, d, first="2024-01-10", last="2024-01-20").rows()))
query("contributor_id", f"{log_sql()} select user_id as contributor_id, count(*) as n, count(distinct changeset_id) as changesets from ct where {WINDOW} group by user_id")(
    lambda s, d: contributions(s, d).rows().groupBy("contributor_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("changeset_id").alias("changesets"))
)


def _folded(v: DataFrame) -> DataFrame:
    v = views.latest_at_time(v)
    was = F.coalesce(F.lag("visible").over(views.history()), F.lit(False))
    return v.withColumn("was", was).where("visible or was")


# -- filters, over snapshots by week and over contributions

FILTERS = {
    "filter_tag_eq": ("kind=view", "kind = 'view'"),
    "filter_tag_any": ("k=*", "k is not null"),
    "filter_tag_ne": ("kind!=view", "kind is distinct from 'view'"),
    "filter_tag_ne_any": ("name!=*", "true"),
    "filter_tag_in": ("kind in (view, click)", "kind in ('view', 'click')"),
    "filter_tag_not_in": ("not kind in (view, click)", "kind not in ('view', 'click')"),
    "filter_type": ("type:way", "osm_type = 'way'"),
    "filter_id_eq": ("id:7", "osm_id = 7"),
    "filter_id_list": ("id:(1,2,30,77)", "osm_id in (1, 2, 30, 77)"),
    "filter_id_range": ("id:(90..20)", "osm_id between 20 and 90"),
    "filter_id_open_range": ("id:(100..) or id:(..5)", "osm_id >= 100 or osm_id <= 5"),
    "filter_id_typed": ("id:(node/3,way/4,way/5)", "(osm_type = 'node' and osm_id = 3) or (osm_type = 'way' and osm_id in (4, 5))"),
    "filter_bool_nesting": ("type:node and (kind=view or not (kind=click or k=7)) or id:(..10)", "(osm_type = 'node' and (kind = 'view' or not (kind = 'click' or k = '7'))) or osm_id <= 10"),
    "filter_negation": ("not (type:way and kind=view) and not id:(10..60)", "not (osm_type = 'way' and kind = 'view') and not osm_id between 10 and 60"),
    "filter_geometry_type": ("geometry:point or geometry:line and kind=purchase", "osm_type = 'node' or (osm_type = 'way' and kind = 'purchase')"),
    "filter_geometry_not": ("not geometry:line", "osm_type <> 'way'"),
    "filter_constant": ("", "true"),
}
for _name, (_text, _condition) in FILTERS.items():
    query(_name, snapshot_sql(_condition))(lambda s, d, text=_text: snapshots(s, d, text).aggregate_by_timestamp().count())

query("filter_two_filters", snapshot_sql("kind = 'view' and osm_type = 'node'"))(lambda s, d: snapshots(s, d, "kind=view").map(F.lit(1)).filter("type:node").aggregate_by_timestamp().count())
query("filter_changeset", f"{log_sql()} select {LOG_COLUMNS} from ct where {WINDOW} and changeset_id between 20240105 and 20240107")(lambda s, d: log(contributions(s, d, "changeset:(20240105..20240107)").rows()))
query("filter_changeset_not_list", f"{log_sql()} select count(*) as result from ct where {WINDOW} and changeset_id not in (20240105, 20240106)")(lambda s, d: contributions(s, d, "not changeset:(20240105,20240106)").count())
query("filter_contributor", f"{log_sql()} select {LOG_COLUMNS} from ct where {WINDOW} and user_id in (1, 7, 49)")(lambda s, d: log(contributions(s, d, "contributor:(1,7,49)").rows()))
query(
    "filter_negation_rows",
    f"{log_sql("kind is distinct from 'view'")} select {LOG_COLUMNS} from ct where {WINDOW} and not (osm_id in (1, 2, 3, 4))",
)(lambda s, d: log(contributions(s, d, "kind!=view and not id:(1,2,3,4)").rows()))


# -- reducers



def k() -> Column:
    """The number that the projection puts in a tag."""
    return F.col("tags")["k"].cast("int")


REDUCERS = {
    "reduce_count": ("count(osm_id)", lambda b: b.count()),
    "reduce_sum": ("coalesce(sum(k::int), 0)::bigint", lambda b: b.sum(k())),
    "reduce_sum_typed": ("round(coalesce(sum(k::int / 4.0), 0), 4)", lambda b: rounded(b.sum(k() / 4.0))),
    "reduce_count_uniq": ("count(distinct kind)", lambda b: b.count_uniq(F.col("tags")["kind"])),
    "reduce_average": ("round(avg(k::int), 4)", lambda b: rounded(b.average(k()))),
    "reduce_weighted_average": ("round(sum(k::double * (osm_id + 1)) / nullif(sum(case when k is not null then osm_id + 1 end), 0), 4)", lambda b: rounded(b.weighted_average(k(), F.col("osm_id") + 1))),
    "reduce_median": ("round(quantile_cont(k::int, 0.5), 4)", lambda b: rounded(b.median(k()))),
    "reduce_quantile": ("round(quantile_cont(k::int, 0.9), 4)", lambda b: rounded(b.quantile(0.9, k()))),
    "reduce_custom": ("coalesce(bit_or(k::bigint), 0)", lambda b: b.aggregate(lambda _: F.bit_or(k().cast("long")), F.lit(0).cast("long"))),
}
for _name, (_sql, _terminal) in REDUCERS.items():
    query(_name, snapshot_sql("osm_type <> 'relation'", _sql))(lambda s, d, t=_terminal: t(snapshots(s, d, "not type:relation").aggregate_by_timestamp()))
    if _name != "reduce_custom":
        query(f"{_name}_scalar", f"with {P.VERSIONS_SQL}, {WEEKS_SQL} select {_sql} as result from days join v on ts <= d and (valid_to is null or d < valid_to) where visible")(lambda s, d, t=_terminal: t(snapshots(s, d)))

query("average_empty_key", snapshot_sql("osm_id < 0", "round(avg(k::int), 4)"))(lambda s, d: rounded(snapshots(s, d).where(F.col("osm_id") < 0).aggregate_by_timestamp().average(k())))
query("reduce_quantiles", snapshot_sql(result="round(quantile_cont(k::int, 0.25), 4)").replace("as result", "as q25, round(quantile_cont(k::int, 0.75), 4) as q75"))(
    lambda s, d: rounded(rounded(snapshots(s, d).aggregate_by_timestamp().quantiles([0.25, 0.75], k()).select("timestamp", F.col("result")[0].alias("q25"), F.col("result")[1].alias("q75")), "q25"), "q75")
)
query("reduce_uniq", f"with {P.VERSIONS_SQL}, {WEEKS_SQL} select d as \"timestamp\", kind as value from days join v on ts <= d and (valid_to is null or d < valid_to) where visible group by all")(
    lambda s, d: snapshots(s, d).aggregate_by_timestamp().uniq(F.col("tags")["kind"]).select("timestamp", F.explode("result").alias("value"))
)
query("collect_sorted", f"with {P.VERSIONS_SQL} select osm_type, osm_id, k::int as value from v where visible and ts <= timestamp '2024-01-15' and (valid_to is null or valid_to > timestamp '2024-01-15')")(
    lambda s, d: P.store(s, d).snapshots().timestamps("2024-01-15").map(F.struct("osm_type", "osm_id", k().alias("value"))).collect_values().select(F.explode("result").alias("r")).select("r.*")
)
query("reduce_python_fold", f"with {P.VERSIONS_SQL}, {WEEKS_SQL} select osm_type, max(k::double) - min(k::double) as result from days join v on ts <= d and (valid_to is null or d < valid_to) where visible and k is not null group by osm_type")(
    lambda s, d: snapshots(s, d)
    .map(k().cast("double"))
    .where(F.col("value").isNotNull())
    .aggregate_by(F.col("osm_type"), name="osm_type")
    .reduce(lambda: None, widening(), widening(), "string")
    .select("osm_type", (F.split("result", ";")[1].cast("double") - F.split("result", ";")[0].cast("double")).alias("result"))
)


def widening():
    """A fold for least and greatest so far, as text; it takes values and other states."""

    def widen(state, x):
        pairs = [tuple(map(float, v.split(";"))) if isinstance(v, str) else (v, v) for v in (state, x) if v is not None]
        return f"{min(p[0] for p in pairs)};{max(p[1] for p in pairs)}" if pairs else None

    return widen


# -- keys

ROWS_SQL = f"with {P.VERSIONS_SQL}, {WEEKS_SQL}, rows as (select d, v.* from days join v on ts <= d and (valid_to is null or d < valid_to) where visible)"
query("aggregate_by_one_key", f"{ROWS_SQL} select kind, count(*) as result from rows group by kind union all select 'none', 0")(lambda s, d: snapshots(s, d).aggregate_by(F.col("tags")["kind"], ["none"], "kind").count())
query(
    "aggregate_by_two_keys",
    f"{ROWS_SQL}, a as (select distinct kind from rows), b as (select distinct osm_type from rows union select 'other') select kind, osm_type, count(osm_id) as result from a cross join b left join rows using (kind, osm_type) group by all",
)(lambda s, d: snapshots(s, d).aggregate_by(F.col("tags")["kind"], name="kind").aggregate_by(F.col("osm_type"), ["other"], "osm_type").count())
query(
    "aggregate_by_three_keys",
    f"{ROWS_SQL}, a as (select distinct kind from rows), b as (select distinct osm_type from rows) select d as \"timestamp\", kind, osm_type, coalesce(sum(k::int), 0)::bigint as result from days cross join a cross join b left join rows using (d, kind, osm_type) group by all",
)(lambda s, d: snapshots(s, d).aggregate_by_timestamp().aggregate_by(F.col("tags")["kind"], name="kind").aggregate_by(F.col("osm_type"), name="osm_type").sum(k()))
query("aggregate_by_custom_ts", f"{ROWS_SQL}, r as (select *, (select max(d) from days x where x.d <= rows.ts) as b from rows where ts >= timestamp '2024-01-01') select days.d as \"timestamp\", count(osm_id) as result from days left join r on r.b = days.d group by days.d")(
    lambda s, d: snapshots(s, d).where(F.col("last_contribution_ts") >= F.lit("2024-01-01").cast("timestamp_ntz")).aggregate_by_timestamp(F.col("last_contribution_ts")).count()
)
REGIONS = {"west": (-1800000000, -900000000, 0, 900000000), "middle": (-300000000, -200000000, 300000000, 200000000), "north": (-1800000000, 100000000, 1800000000, 900000000), "empty": (1, 1, 2, 2)}
REGIONS_SQL = "regions as (select * from (values " + ", ".join(f"('{n}', {a}, {b}, {c}, {e})" for n, (a, b, c, e) in REGIONS.items()) + ") t(region, a, b, c, e))"
query("aggregate_by_bbox_region", f"{ROWS_SQL}, {REGIONS_SQL} select region, count(osm_id) as result from regions left join rows on lon_e7 between a and c and lat_e7 between b and e group by region")(lambda s, d: snapshots(s, d).aggregate_by_geometry(REGIONS).count())
query(
    "group_by_entity_flatmap",
    f"{ROWS_SQL} select osm_type, osm_id, count(*) as n, count(distinct version) as states from rows group by all",
)(lambda s, d: snapshots(s, d).group_by_entity().rows().select("osm_type", "osm_id", F.size("rows").cast("long").alias("n"), F.size(F.array_distinct(F.col("rows.version"))).cast("long").alias("states")))
query(
    "map_flatmap_filter",
    f"{ROWS_SQL}, x as (select unnest([k::int, k::int * 2, osm_id::int]) as value from rows) select value % 10 as key1, count(*) as result from x where value > 20 group by all",
)(lambda s, d: snapshots(s, d).flat_map(F.array(k(), k() * 2, F.col("osm_id").cast("int"))).where(F.col("value") > 20).aggregate_by(F.col("value") % 10).count())
query("map_python", f"{ROWS_SQL} select sum(k::int % 7)::bigint as result from rows")(lambda s, d: snapshots(s, d).map(k()).map_python(lambda x: int(x) % 7, "long").sum())
query("union_types", f"with {P.VERSIONS_SQL} select osm_type, count(*) as n from versions group by osm_type")(lambda s, d: P.versions(s, d).groupBy("osm_type").agg(F.count(F.lit(1)).alias("n")))
query("metadata_lookup", "select 'extract.region' as key, 'globe' as value")(lambda s, d: P.store(s, d).metadata.where("key = 'extract.region'"))

# -- members

WAYS_SQL = f"""with {P.VERSIONS_SQL}, ways as (select *, list_distinct(case when event_id % 2 = 0 then [event_id * 7 % 50 * 3, event_id * 11 % 50 * 3, event_id * 13 % 50 * 3] else [event_id * 7 % 50 * 3, event_id * 11 % 50 * 3] end) as ms
  from v where osm_type = 'way'), refs as (select osm_type, osm_id, ts, valid_to, visible, unnest(ms) as m from ways), nodes as (select * from v where osm_type = 'node')"""
query(
    "asof_member_join",
    f"{WAYS_SQL} select r.osm_id, r.ts, r.m as member, n.version as member_version, n.visible as member_visible from refs r left join nodes n on n.osm_id = r.m and n.ts <= r.ts and (n.valid_to is null or r.ts < n.valid_to)",
)(lambda s, d: _asof(s, d))
query(
    "member_mod_times",
    f"{WAYS_SQL} select distinct osm_id, ts from (select osm_id, ts from ways union all select r.osm_id, n.ts from refs r join nodes n on n.osm_id = r.m and n.ts >= r.ts and (r.valid_to is null or n.ts <= r.valid_to) where r.visible)",
)(lambda s, d: members.modification_times(P.ways(s, d), P.nodes(s, d)).select("osm_id", "ts"))


def _asof(s, d):
    refs = P.ways(s, d).select("osm_id", "ts", F.explode(F.array_distinct(F.col("members.id"))).alias("member"))
    right = P.nodes(s, d).select(F.col("osm_id").alias("member"), "ts", "version", "visible")
    out = members.asof_join(refs, right, ["member"])
    return out.select("osm_id", "ts", "member", F.col("m_version").cast("long").alias("member_version"), F.col("m_visible").alias("member_visible"))


MEMBER_LOG_SQL = f"""with {P.VERSIONS_SQL}, ways as (
  select *, case when event_id % 2 = 0 then [event_id * 7 % 50 * 3, event_id * 11 % 50 * 3, event_id * 13 % 50 * 3]
    else [event_id * 7 % 50 * 3, event_id * 11 % 50 * 3] end as ms
  from v where osm_type = 'way'
), nodes as (select * from v where osm_type = 'node'
), refs as (
  select osm_id, ts, valid_to, visible, unnest(ms) as m from ways
), causes as (
  select osm_id, ts, changeset_id, 0 as rank, 0 as cause, version from ways
  union all select r.osm_id, n.ts, n.changeset_id, 2, n.osm_id, n.version
  from refs r join nodes n on n.osm_id = r.m and n.ts >= r.ts and (r.valid_to is null or n.ts <= r.valid_to) where r.visible
), times as (
  select osm_id, ts, changeset_id from causes qualify row_number() over (partition by osm_id, ts order by rank, cause, version desc) = 1
), state as (
  select t.*, w.visible as alive, w.kind, w.k, w.version, w.ms from times t join ways w on w.osm_id = t.osm_id and w.ts <= t.ts and (w.valid_to is null or t.ts < w.valid_to)
), ref as (
  select osm_id, ts, unnest(ms) as m, generate_subscripts(ms, 1) as pos from state
), line as (
  select ref.osm_id, ref.ts, list((n.lon_e7, n.lat_e7) order by ref.pos) as coords
  from ref join nodes n on n.osm_id = ref.m and n.visible and n.ts <= ref.ts and (n.valid_to is null or ref.ts < n.valid_to) group by all
), st as (select state.*, coords from state left join line using (osm_id, ts)
), fold as (
  select * from (select *, coalesce(lag(alive) over w, false) as was from st window w as (partition by osm_id order by ts)) where alive or was
), sq as (
  select * from (select *, lead(changeset_id) over w as nx from fold window w as (partition by osm_id order by ts)) where nx is null or nx <> changeset_id
), em as (
  select *, coalesce(lag(alive) over w, false) as before_alive, lag(kind) over w as b_kind, lag(k) over w as b_k, lag(version) over w as b_version, lag(coords) over w as b_coords
  from sq window w as (partition by osm_id order by ts)
)
select 'way' as osm_type, osm_id, ts, alive and not before_alive as creation, not alive as deletion,
  alive and before_alive and (b_kind is distinct from kind or b_k is distinct from k) as tag_change,
  alive and before_alive and b_coords is distinct from coords as geometry_change, b_version as before_version, version as after_version
from em where (alive or before_alive) and {WINDOW}"""


@query("member_contributions", MEMBER_LOG_SQL)
def _member_contributions(s, d):
    return log(views.contributions(P.ways(s, d), timeline.instants(FIRST, LAST, "P1D"), None, P.nodes(s, d)))


# -- grid and areas

CELL_SQL = "case when lon_e7 between -1800000000 and 1800000000 and lat_e7 between -900000000 and 900000000 then floor(least(lat_e7 + 900000000, 1799999999) / (3600000000.0 / {n}))::bigint * {n} + floor(((lon_e7 + 1800000000) % 3600000000) / (3600000000.0 / {n}))::bigint else -1 end"
query("grid_cell_id", f"with {P.VERSIONS_SQL} select {CELL_SQL.format(n=4096)} as cell, count(*) as n from versions group by all")(
    lambda s, d: P.versions(s, d).groupBy(grid.cell_id_column(12, F.col("lon_e7"), F.col("lat_e7")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
)
BOXES_SQL = f"with {P.VERSIONS_SQL}, boxes as (select osm_id, changeset_id, min(lon_e7) as a, min(lat_e7) as b, max(lon_e7) as c, max(lat_e7) as e from versions group by all)"
LEVEL_SQL = "(select max(z) from range(0, 15) t(z) where greatest(ceil(c / (3600000000.0 / (1 << z))) - floor(a / (3600000000.0 / (1 << z))), ceil(e / (3600000000.0 / (1 << z))) - floor(b / (3600000000.0 / (1 << z)))) <= 2)"
query("grid_insert_level", f"{BOXES_SQL} select {LEVEL_SQL}::int as level, count(*) as n from boxes group by all")(lambda s, d: store.filed(_boxes(s, d)).groupBy("level").agg(F.count(F.lit(1)).alias("n")))


def _boxes(s, d):
    v = P.versions(s, d)
    return v.groupBy("osm_id", "changeset_id").agg(F.min("lon_e7").alias("min_lon"), F.min("lat_e7").alias("min_lat"), F.max("lon_e7").alias("max_lon"), F.max("lat_e7").alias("max_lat"), F.first("osm_type").alias("osm_type"))


def _stored(s, d):
    path = store.shared_path(s, "boxes")
    store.write_store(store.filed(_boxes(s, d)), path)
    return path


BOX = (-100000000, -50000000, 350000000, 250000000)
RANGES_SQL = f"""with levels as (
  select z as level, 3600000000.0 / (1 << z) as w from range(0, 15) t(z)
), corners as (
  select level, floor(({BOX[0]}::bigint + 1800000000) / w)::bigint as x1, floor(({BOX[2]}::bigint + 1800000000) / w)::bigint as x2,
    floor(({BOX[1]}::bigint + 900000000) / w)::bigint as y1, floor(({BOX[3]}::bigint + 900000000) / w)::bigint as y2
  from levels
), lines as (select *, unnest(range(greatest(y1 - 1, 0), y2 + 1)) as y from corners)
select level::int as level, row_number() over (partition by level order by y)::bigint as i,
  (y * (1 << level) + greatest(x1 - 1, 0))::bigint as low, (y * (1 << level) + x2)::bigint as high
from lines"""


@query("grid_bbox_ranges", RANGES_SQL)
def _ranges(s, d):
    """Every range of every level of the box."""
    rows = [(z, i + 1, lo, hi) for z in range(15) for i, (lo, hi) in enumerate(grid.ranges(z, BOX))]
    return s.createDataFrame(rows, "level int, i long, low long, high long")


query("grid_pruned_scan", f"{BOXES_SQL} select osm_id, changeset_id from boxes where a <= {BOX[2]} and c >= {BOX[0]} and b <= {BOX[3]} and e >= {BOX[1]}")(
    lambda s, d: store.read_store(s, _stored(s, d), BOX).select("osm_id", "changeset_id")
)
# after folding and squashing, states outside the box count as dead
AREA_LOG_SQL = log_sql().replace("em as (select *,", f"sa as (select * replace (alive and lon_e7 between {BOX[0]} and {BOX[2]} and lat_e7 between {BOX[1]} and {BOX[3]} as alive) from sq),\nem as (select *,").replace("as b_lat from sq", "as b_lat from sa") + f" select {LOG_COLUMNS} from ct where {WINDOW}"
query("aoi_bbox", snapshot_sql(f"lon_e7 between {BOX[0]} and {BOX[2]} and lat_e7 between {BOX[1]} and {BOX[3]}"))(lambda s, d: snapshots(s, d).area_of_interest(BOX).aggregate_by_timestamp().count())
query("aoi_bbox_intersection", snapshot_sql("lon_e7 between 0 and 350000000 and lat_e7 between -50000000 and 100000000"))(lambda s, d: snapshots(s, d).area_of_interest(BOX).area_of_interest((0, -900000000, 1800000000, 100000000)).aggregate_by_timestamp().count())
query("aoi_contributions", AREA_LOG_SQL)(lambda s, d: log(contributions(s, d).area_of_interest(BOX).rows()))
TRIANGLE = [[(-1000000000, -500000000), (1000000000, -500000000), (0, 500000000), (-1000000000, -500000000)]]
query("aoi_polygon", snapshot_sql("lat_e7 >= -500000000 and lat_e7 <= 500000000 and lat_e7 + 500000000 <= lon_e7 + 1000000000 and lat_e7 + 500000000 <= 1000000000 - lon_e7"))(lambda s, d: snapshots(s, d).area_of_interest(TRIANGLE).aggregate_by_timestamp().count())
query("aoi_empty", snapshot_sql("false"))(lambda s, d: snapshots(s, d).area_of_interest((0, 0, 10, 10)).area_of_interest((100, 100, 110, 110)).aggregate_by_timestamp().count())

# -- times


def _times(name: str, values: list, sql: str):
    query(name, sql)(lambda s, d: s.createDataFrame([(t,) for t in values], "ts timestamp_ntz"))


for _name, _period, _end in (("yearly", "P1Y", "2021-03-01"), ("quarterly", "P3M", "2017-08-31"), ("monthly", "P1M", "2017-03-31"), ("weekly", "P7D", "2016-09-30"), ("daily", "P1D", "2016-05-02"), ("hourly", "PT1H", "2016-03-03")):
    _step = {"P1Y": "n * interval 1 year", "P3M": "n * interval 3 month", "P1M": "n * interval 1 month", "P7D": "n * interval 7 day", "P1D": "n * interval 1 day", "PT1H": "n * interval 1 hour"}[_period]
    _times(f"timestamps_interval_{_name}", timeline.instants("2016-02-29T06:30:15", _end, _name), f"select ts from (select timestamp '2016-02-29 06:30:15' + {_step} as ts from range(0, 2000) t(n)) where ts <= timestamp '{_end}'")
_times("timestamps_period_from_end", timeline.instants("2019-11-10", "2020-10-31", "P1M", from_end=True), "select ts from (select timestamp '2020-10-31' - n * interval 1 month as ts from range(0, 100) t(n)) where ts >= timestamp '2019-11-10'")
ISO = {
    "2016": "2016-01-01",
    "201602": "2016-02-01",
    "2016-02": "2016-02-01",
    "20160229": "2016-02-29",
    "2016-02-29": "2016-02-29",
    "2016-02-29T06": "2016-02-29 06:00:00",
    "2016-02-29T06:30": "2016-02-29 06:30:00",
    "2016-02-29T06:30:15Z": "2016-02-29 06:30:15",
    "2016-02-29T06:30:15.250": "2016-02-29 06:30:15.250",
}
query("iso_parse_layouts", "select * from (values " + ", ".join(f"('{x}', timestamp '{t}')" for x, t in ISO.items()) + ") t(layout, ts)")(
    lambda s, d: s.createDataFrame([(x, timeline.parse_iso(x)) for x in ISO], "layout string, ts timestamp_ntz")
)

# -- geometries

SEGMENTS_SQL = f"""with {P.POINTS_SQL}, sp as (select *, radians(lon) as x, atan({LENGTH_SHARE} * tan(radians(lat))) as y from points),
seg as (select osm_id, lead(x) over w - x as dx, lead(y) over w - y as dy, (lead(y) over w + y) / 2 as ym from sp window w as (partition by osm_id order by i)),
len as (select osm_id, coalesce(sum(sqrt(pow(dx * cos(ym), 2) + dy * dy)), 0) * {geo.RADIUS_MEAN} as length from seg group by osm_id)"""
RINGS_SQL = f"""with {P.POINTS_SQL}, closed as (select * from points union all select osm_id, lon, lat, (select max(i) + 1 from points q where q.osm_id = p.osm_id) as i from points p where i = 1),
cyc as (select osm_id, lat, coalesce(lead(lon) over w, first_value(lon) over w) - coalesce(lag(lon) over w, last_value(lon) over (partition by osm_id order by i rows between unbounded preceding and unbounded following)) as dx, {geo.POLAR_SHARE!r} * tan(radians(lat)) as t
  from closed window w as (partition by osm_id order by i)),
ar as (select osm_id, abs(sum(radians(dx) * t / sqrt(t * t + 1)) * 0.5 * {geo.RADIUS_EQUATOR}::double * {geo.RADIUS_EQUATOR}::double * (1 - pow(cos(radians((max(lat) + min(lat)) / 2)), 2) / {geo.INVERSE_FLATTENING})) as area from cyc group by osm_id having count(*) > 3)"""


def rings(s, d) -> DataFrame:
    """Closed rings of the orders' places, three places or more."""
    return P.lines(s, d).where(F.size("coords") > 2).withColumn("coords", F.concat("coords", F.slice("coords", 1, 1)))


def band(column: Column, places: int = 2) -> Column:
    return F.round(column, places)


query("geo_length", f"{SEGMENTS_SQL} select osm_id, round(length, 2) as length from len")(lambda s, d: P.lines(s, d).select("osm_id", band(geo.length_column(F.col("coords"))).alias("length")))
query("geo_area", f"{RINGS_SQL} select osm_id, round(area / 1000, 2) as area from ar")(lambda s, d: rings(s, d).select("osm_id", band(geo.polygon_area_column(F.col("coords")) / 1000).alias("area")))
BEARING_SQL = f"""with {P.POINTS_SQL}, w as (
  select osm_id, radians(lon) as x1, radians(lat) as y1, radians(lead(lon) over w) as x2, radians(lead(lat) over w) as y2, i
  from points window w as (partition by osm_id order by i)
)
select osm_id, round((atan2(sin(x2 - x1) * cos(y2), cos(y1) * sin(y2) - sin(y1) * cos(y2) * cos(x2 - x1)) + 2 * pi()) % (2 * pi()), 6) as bearing
from w where i = 1 and x2 is not null"""
query("geo_bearing", BEARING_SQL)(
    lambda s, d: P.lines(s, d).where(F.size("coords") > 1).select("osm_id", band(geo.bearing_column(F.col("coords")[0], F.col("coords")[1]), 6).alias("bearing"))
)
RING_LENGTH_SQL = f"""{RINGS_SQL}, sp as (select *, radians(lon) as x, atan({LENGTH_SHARE} * tan(radians(lat))) as y from closed),
seg as (select osm_id, lead(x) over w - x as dx, lead(y) over w - y as dy, (lead(y) over w + y) / 2 as ym from sp window w as (partition by osm_id order by i)),
per as (select osm_id, sum(sqrt(pow(dx * cos(ym), 2) + dy * dy)) * {geo.RADIUS_MEAN} as perimeter from seg group by osm_id),
m as (select osm_id, area, perimeter, case when perimeter > 0 then 4 * {math.pi!r} * area / (perimeter * perimeter) else 0 end as roundness, n as vertices from ar join per using (osm_id) join (select osm_id, count(*) as n from closed group by osm_id) using (osm_id))"""
query("geo_roundness", f"{RING_LENGTH_SQL} select osm_id, round(roundness, 6) as roundness from m")(
    lambda s, d: rings(s, d).select("osm_id", band(geo.roundness_column(geo.polygon_area_column(F.col("coords")), geo.length_column(F.col("coords"))), 6).alias("roundness"))
)


CLIP = (8.2, 49.2, 8.7, 49.7)
CLIP_SQL = f"""with {P.POINTS_SQL}, s as (select osm_id, lon as x, lat as y, lead(lon) over w - lon as dx, lead(lat) over w - lat as dy from points window w as (partition by osm_id order by i)),
t as (select *, case when dx = 0 then case when x between {CLIP[0]} and {CLIP[2]} then 0 else 2 end else least(({CLIP[0]} - x) / dx, ({CLIP[2]} - x) / dx) end as ax, case when dx = 0 then 1 else greatest(({CLIP[0]} - x) / dx, ({CLIP[2]} - x) / dx) end as bx,
  case when dy = 0 then case when y between {CLIP[1]} and {CLIP[3]} then 0 else 2 end else least(({CLIP[1]} - y) / dy, ({CLIP[3]} - y) / dy) end as ay, case when dy = 0 then 1 else greatest(({CLIP[1]} - y) / dy, ({CLIP[3]} - y) / dy) end as by_ from s where dx is not null),
c as (select *, greatest(0, ax, ay) as t0, least(1, bx, by_) as t1 from t),
g as (select osm_id, radians((t1 - t0) * dx) as dl, atan({LENGTH_SHARE} * tan(radians(y + t0 * dy))) as y0, atan({LENGTH_SHARE} * tan(radians(y + t1 * dy))) as y1 from c where t0 < t1),
l as (select osm_id, sum(sqrt(pow(dl * cos((y0 + y1) / 2), 2) + pow(y1 - y0, 2))) * {geo.RADIUS_MEAN} as length from g group by osm_id)
select osm_id, round(coalesce(length, 0), 2) as length from (select distinct osm_id from points) left join l using (osm_id)"""
query("aoi_clip_length", CLIP_SQL)(lambda s, d: P.lines(s, d).select("osm_id", band(geometry.clipped_length_column(F.col("coords"), CLIP)).alias("length")))
WAY_GEOMETRY_SQL = f"""with {P.VERSIONS_SQL}, nodes as (select * from v where osm_type = 'node' and visible),
r as (select osm_id, ts, unnest(case when event_id % 2 = 0 then [event_id * 7 % 50 * 3, event_id * 11 % 50 * 3, event_id * 13 % 50 * 3] else [event_id * 7 % 50 * 3, event_id * 11 % 50 * 3] end) as m from v where osm_type = 'way'),
p as (select r.osm_id, r.ts, count(n.osm_id) as k from r left join nodes n on n.osm_id = r.m and n.ts <= r.ts and (n.valid_to is null or r.ts < n.valid_to) group by all)
select case when k = 0 then null when k = 1 then 'point' else 'line' end as geometry, count(*) as n, sum(k)::bigint as points from p group by 1"""
query("way_geometry_at_time", WAY_GEOMETRY_SQL)(lambda s, d: geometry.way_coords(P.ways(s, d), P.nodes(s, d)).groupBy(geometry.way_geometry_column(F.col("coords"), F.col("tags")).alias("geometry")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("coords")).alias("points")))
