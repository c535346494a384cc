"""Joins along member references: as-of lookups, membership intervals and the modification times that members cause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTITY = ["osm_type", "osm_id"]


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts", order: str = "version", prefix: str = "m_") -> DataFrame:
    """left with the newest row of right of the same keys whose ts is not later; null where there is none.

    Both sides are put in one sequence per key and the last right row is carried on: one shuffle by the keys and no
    product of sides. left needs nothing unique; equal times count as not later, the higher `order` wins.
    """
    values = [c for c in right.columns if c not in keys]
    mine = [c for c in left.columns if c not in keys]
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    # rows stay flat: only what the right side has goes into the struct that is carried on
    a = left.select(*keys, F.col(ts).alias("__ts"), F.lit(1).alias("__side"), null(right, order).alias("__order"), *[F.col(c).alias(f"l__{c}") for c in mine], *[null(right, c).alias(f"r__{c}") for c in values])
    b = right.select(*keys, F.col(ts).alias("__ts"), F.lit(0).alias("__side"), F.col(order).alias("__order"), *[null(left, c).alias(f"l__{c}") for c in mine], *[F.col(c).alias(f"r__{c}") for c in values])
    w = Window.partitionBy(*keys).orderBy("__ts", "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.when(F.col("__side") == 0, F.struct(*[F.col(f"r__{c}").alias(c) for c in values]))
    out = a.union(b).withColumn("__r", F.last(carried, ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*[F.col(c if c in keys else f"l__{c}").alias(c) for c in left.columns], *[F.col(f"__r.{c}").alias(f"{prefix}{c}") for c in values])


def lifetimes(versions: DataFrame, *columns) -> DataFrame:
    """osm_id, since, until (null while it holds) and columns of the versions of entities of one type; of versions of one time the last."""
    w = Window.partitionBy("osm_id").orderBy("since", "version")
    v = versions.select("osm_id", "version", F.col("ts").alias("since"), *columns).withColumn("until", F.lead("since").over(w))
    return v.where("until is null or until > since").drop("version")


def membership_intervals(parents: DataFrame) -> DataFrame:
    """osm_type, osm_id, m_type, m_id, since, until: stretches of adjacent visible versions that keep a member; until is null while it stays."""
    w = Window.partitionBy(*ENTITY).orderBy("ts", "version")
    v = parents.withColumn("n", F.row_number().over(w)).withColumn("until", F.lead("ts").over(w)).where("visible and members is not null")
    m = v.select(*ENTITY, "n", F.col("ts").alias("since"), "until", F.explode(F.array_distinct(F.transform("members", lambda x: F.struct(x["type"].alias("type"), x["id"].alias("id"))))).alias("m"))
    m = m.select(*ENTITY, "n", "since", "until", F.col("m.type").alias("m_type"), F.col("m.id").alias("m_id"))
    per = Window.partitionBy(*ENTITY, "m_type", "m_id").orderBy("n")
    island = m.withColumn("island", F.col("n") - F.row_number().over(per))
    return island.groupBy(*ENTITY, "m_type", "m_id", "island").agg(F.min("since").alias("since"), F.max_by("until", "n").alias("until")).drop("island")


def modification_times(parents: DataFrame, members: DataFrame | None) -> DataFrame:
    """osm_type, osm_id, ts, changeset_id, user_id, own: every time at which an entity changes, by itself or by a member.

    A member's change counts while it is a member, both ends of the stretch included; a way that is a relation's member
    changes with its nodes too, and relations that are members cause no change. Of several causes at one time the entity's
    own version gives changeset and user, else the first member's.
    """
    own = parents.select(*ENTITY, "ts", "changeset_id", "user_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("by"), F.col("version").alias("v"))
    if members is not None:
        spans = membership_intervals(parents)
        nodes, ways = (members.where(F.col("osm_type") == t) for t in ("node", "way"))
        of_ways = spans.where("m_type = 'way'").select(F.lit("way").alias("osm_type"), F.col("m_id").alias("osm_id")).distinct()
        nested = _with_members(ways.join(of_ways, ENTITY, "left_semi"), nodes)
        changes = nodes.select(*ENTITY, "ts", "changeset_id", "user_id", "version").union(nested.select(*ENTITY, "ts", "changeset_id", "user_id", F.lit(0)))
        own = own.union(_caused(spans, changes))
    return _first(own)


def _with_members(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """The times of ways by themselves and their nodes."""
    own = parents.select(*ENTITY, "ts", "changeset_id", "user_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("by"), F.col("version").alias("v"))
    return _first(own.union(_caused(membership_intervals(parents), nodes.select(*ENTITY, "ts", "changeset_id", "user_id", "version"))))


def _caused(spans: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes of members within the stretches in which they are members."""
    changes = changes.select(F.col("osm_type").alias("m_type"), F.col("osm_id").alias("m_id"), "ts", "changeset_id", "user_id", "version")
    met = spans.join(changes, ["m_type", "m_id"]).where((F.col("ts") >= F.col("since")) & (F.col("until").isNull() | (F.col("ts") <= F.col("until"))))
    rank = F.when(F.col("m_type") == "node", 2).otherwise(1)
    return met.select(*ENTITY, "ts", "changeset_id", "user_id", rank.alias("rank"), F.col("m_id").alias("by"), F.col("version").alias("v"))


def _first(causes: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("changeset_id", "user_id", (F.col("rank") == 0).alias("own")), F.struct("rank", "by", -F.col("v")))
    return causes.groupBy(*ENTITY, "ts").agg(first.alias("f")).select(*ENTITY, "ts", "f.changeset_id", "f.user_id", "f.own")
