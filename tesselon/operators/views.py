"""The two views over entity histories: states at instants, and the log of contributions.

Versions come as rows of `model.VERSIONS`. All work is windows over one entity's history, so one shuffle by entity; a
list of instants is a literal that rows are matched with in place, not a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.filters import TYPES, And, Constant, Node, State, Type, selective
from tesselon.operators import shapes
from tesselon.operators.members import ENTITY, asof_join, modification_times


def history():
    """The versions of one entity, in order."""
    return Window.partitionBy(*ENTITY).orderBy("ts", "version")


def instants_column(instants: list[datetime]):
    return F.array(*[F.lit(t) for t in instants]).cast("array<timestamp_ntz>")


def floor_column(ts, instants: list[datetime]):
    """The latest of the instants that is not after ts; null before the first."""
    return F.element_at(F.filter(instants_column(instants), lambda t: t <= ts), -1) if len(instants) else F.lit(None).cast("timestamp_ntz")


def prefiltered(versions: DataFrame, flt: Node) -> DataFrame:
    """Scans that need not be read: implied entity types, and histories without the tag keys if the table has them (tag_keys)."""
    types = flt.types()
    if len(types) < 3:
        versions = versions.where(F.col("osm_type").isin(*sorted(types)) if types else F.lit(False))
    if "tag_keys" in versions.columns:
        for key in sorted(flt.keys()):
            versions = versions.where(F.array_contains("tag_keys", key))
    return versions


def latest_at_time(versions: DataFrame) -> DataFrame:
    """Of versions with one time, the last; with valid_to: the time of the next one."""
    return versions.withColumn("valid_to", F.lead("ts").over(history())).where("valid_to is null or valid_to > ts")


def measured(s: State, flt: Node, shape: Column, known: list[str] = ()) -> State:
    """The state with the metrics that a filter names, of a shape; those in `known` are columns already."""
    return replace(s, **{m: shapes.metric(shape, m) for m in flt.metrics() if m not in known})


def snapshots(
    versions: DataFrame,
    instants: list[datetime],
    flt: Node | None = None,
    members: DataFrame | None = None,
    row_filter: bool = True,
    shaped: bool = False,
    rules: shapes.AreaRules | None = None,
) -> DataFrame:
    """A row for each instant and entity: snapshot_ts, last_contribution_ts and the columns of the version valid then.

    Deleted versions, ways and relations without members, and what the filter refuses have no row. With `shaped`, or where the
    filter asks for geometries, there is a column `shape` (see shapes); without members' versions the types of geometries are
    those that the entities' types suggest.
    """
    flt = flt or Constant(True)
    versions = prefiltered(versions, flt)
    unknown = flt.metrics() - set(versions.columns)
    by_shape = bool(unknown if members is not None else unknown - {"geometry"})
    if members is not None and (shaped or by_shape) and len(flt.types()) > 1:  # each type by itself: only what its shapes need is joined
        parts = [snapshots(versions, instants, And(flt, Type(t)), members, row_filter, shaped, rules) for t in TYPES if t in flt.types()]
        return reduce(DataFrame.unionByName, parts)
    v = latest_at_time(versions)
    s = State.of(v.columns)
    alive = F.col("visible") & ((F.col("osm_type") == "node") | F.col("members").isNull() | (F.size("members") > 0))
    v = v.where(alive & flt.version(s))
    if row_filter and not by_shape:
        v = v.where(flt.row(s))
    valid = F.filter(instants_column(instants), lambda t: (t >= F.col("ts")) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))
    known = v.columns
    if shaped or by_shape:
        known = [c for c in known if c != "valid_to"]
        v = v.withColumn(shapes.TIMES, valid).where(F.size(shapes.TIMES) > 0).drop("valid_to")
        out = shapes.with_shapes(v, members, "snapshot_ts", rules, instants, flt.types())
        if row_filter and by_shape:
            known = [*known, *(["geometry"] if members is None else [])]
            # each metric is worked out once, whatever the filter asks of it
            metrics = [m for m in sorted(flt.metrics()) if m not in known]
            out = out.select("*", F.inline_outer(F.array(F.struct(*[shapes.metric(F.col("shape"), m).alias(f"m__{m}") for m in metrics]))))
            out = out.where(flt.row(replace(s, **{m: F.col(f"m__{m}") for m in metrics}))).drop(*[f"m__{m}" for m in metrics])
    else:
        out = v.withColumn("snapshot_ts", F.explode(valid)).drop("valid_to")
    if members is None:
        return out.withColumn("last_contribution_ts", F.col("ts"))
    times = modification_times(versions, members).select(*ENTITY, F.col("ts").alias("mod_ts"), F.lit(0).alias("version"))
    return _last_change(out, times)


def _last_change(rows: DataFrame, times: DataFrame) -> DataFrame:
    right = times.select(*ENTITY, F.col("mod_ts").alias("snapshot_ts"), "version", "mod_ts")
    return asof_join(rows, right, ENTITY, "snapshot_ts", "version", "l_").withColumn("last_contribution_ts", F.col("l_mod_ts")).drop("l_snapshot_ts", "l_version", "l_mod_ts")


def squashed(times: DataFrame) -> DataFrame:
    """Of consecutive times of one changeset only the last."""
    w = Window.partitionBy(*ENTITY).orderBy("ts")
    following = F.lead("changeset_id").over(w)
    return times.withColumn("__next", following).where("__next is null or __next <> changeset_id").drop("__next")


#: What a contribution shows of the states before and after; with members or where shapes are asked for also `shape`.
SHOWN = ("version", "tags", "lon_e7", "lat_e7", "members")


def contributions(
    versions: DataFrame,
    instants: list[datetime] | None = None,
    flt: Node | None = None,
    members: DataFrame | None = None,
    row_filter: bool = True,
    clip: Callable[[DataFrame], DataFrame] | None = None,
    shaped: bool = False,
    rules: shapes.AreaRules | None = None,
) -> DataFrame:
    """The change log: ts, changeset_id, contributor_id, creation, deletion, tag_change, geometry_change, before, after.

    Runs of versions that are deleted or that the filter refuses count as one end; then changesets are squashed; then the
    state at each time is compared with the state emitted before. `clip` cuts the column `shape` of the states to the area of
    interest (null for none): moving in is a creation, moving out a deletion; `full_shape` keeps them whole, and filters
    judge by it. Only times in [first, last) of the instants are given out, but all earlier ones count for the state before.
    """
    flt = flt or Constant(True)
    # the type is a version's for good, so histories of other types may go; versions that do not match must stay
    versions = prefiltered(versions, flt)
    if members is not None and len(flt.types()) > 1:
        parts = [contributions(versions, instants, And(flt, Type(t)), members, row_filter, clip, shaped, rules) for t in TYPES if t in flt.types()]
        return reduce(DataFrame.unionByName, parts)
    if members is not None and selective(flt):  # histories of which no version ever matches have no state to show
        ever = F.max(F.col("visible") & flt.version(State.of(versions.columns))).over(Window.partitionBy(*ENTITY))
        versions = versions.withColumn("__ever", ever).where("__ever").drop("__ever")
    v = latest_at_time(versions)
    v = v.withColumn("alive", F.col("visible") & flt.version(State.of(v.columns)))
    shown = list(SHOWN)
    if members is None:
        rows = v.select(*ENTITY, "ts", "alive", *shown, "changeset_id", "user_id")
    else:
        state = v.select(*ENTITY, "ts", "alive", *shown)
        rows = asof_join(modification_times(versions, members), state, ENTITY, "ts", "version", "s_").where("s_version is not null")
        same = Window.partitionBy(*ENTITY, "s_ts")
        span = [f("ts").over(same).alias(c) for f, c in zip((F.min, F.max), shapes.SPAN, strict=True)]
        rows = rows.select(*ENTITY, "ts", F.col("s_alive").alias("alive"), *[F.col(f"s_{c}").alias(c) for c in shown], "changeset_id", "user_id", *span)
    shaped = shaped or members is not None or clip is not None or bool(flt.metrics() - {"geometry"})
    if shaped:
        rows = shapes.with_shapes(rows, members, "ts", rules, types=flt.types())
        shown.append("shape")
    w = Window.partitionBy(*ENTITY).orderBy("ts")
    rows = rows.withColumn("was", F.coalesce(F.lag("alive").over(w), F.lit(False))).where("alive or was").drop("was")
    rows = squashed(rows)
    whole = "shape"
    if clip is not None:
        whole = "full_shape"
        shown.append(whole)
        rows = clip(rows.withColumn(whole, F.col("shape")))
        rows = rows.withColumn("alive", F.col("alive") & F.col("shape").isNotNull())
    state = F.struct(*shown)
    rows = rows.withColumn("before_alive", F.coalesce(F.lag("alive").over(w), F.lit(False))).withColumn("before", F.lag(state).over(w))
    rows = rows.where("alive or before_alive")

    def place(side: str) -> Column:
        if members is not None:
            return F.col(f"{side}.shape")
        return F.struct(F.col(f"{side}.lon_e7"), F.col(f"{side}.lat_e7"), F.col(f"{side}.members"))

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    tags = lambda side: F.array_sort(F.map_entries(F.coalesce(F.col(f"{side}.tags"), none)))
    rows = rows.withColumn("after", state)
    both = F.col("alive") & F.col("before_alive")
    rows = rows.select(
        *ENTITY,
        "ts",
        "changeset_id",
        F.coalesce("user_id", F.lit(-1)).alias("contributor_id"),
        (F.col("alive") & ~F.col("before_alive")).alias("creation"),
        (~F.col("alive")).alias("deletion"),
        (both & (tags("before") != tags("after"))).alias("tag_change"),
        (both & ~place("before").eqNullSafe(place("after"))).alias("geometry_change"),
        "before",
        "after",
    )
    if row_filter and not isinstance(flt, Constant):

        def side(name: str) -> State:
            s = State(F.col("osm_type"), F.col("osm_id"), F.col(f"{name}.tags"), F.col(f"{name}.members"), changeset=F.col("changeset_id"), contributor=F.col("contributor_id"))
            return measured(s, flt, F.col(f"{name}.{whole}"), ["geometry"] if members is None else []) if shaped else s

        rows = rows.where(flt.contribution(side("before"), side("after"), F.col("creation"), F.col("deletion")))
    if instants:
        rows = rows.where((F.col("ts") >= F.lit(instants[0]).cast("timestamp_ntz")) & (F.col("ts") < F.lit(instants[-1]).cast("timestamp_ntz")))
    return rows
