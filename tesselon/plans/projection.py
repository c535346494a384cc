"""A projection of the driver's tables onto the engine's schema, for registered queries and tests only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesselon.operators.pipeline import Store


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories from events: a user is an entity, an event a version."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    osm_type = F.when(F.col("user_id") % 3 == 0, "node").when(F.col("user_id") % 3 == 1, "way").otherwise("relation")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    place = lambda a, n, h: (((F.col("event_id") * a) % n) * 1000 - h).cast("int")
    return e.select(
        osm_type.alias("osm_type"),
        F.col("user_id").alias("osm_id"),
        number.alias("version"),
        (F.col("event_type") != "error").alias("visible"),
        "ts",
        F.date_format("ts", "yyyyMMdd").cast("long").alias("changeset_id"),
        (F.col("event_id") % 50).cast("int").alias("user_id"),
        F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")).alias("tags"),
        place(7919, 3600000, 1800000000).alias("lon_e7"),
        place(104729, 1800000, 900000000).alias("lat_e7"),
        F.lit(None).cast("array<struct<type: string, id: bigint, role: string>>").alias("members"),
    )


def store(spark: SparkSession, sf_dir: str) -> Store:
    meta = spark.createDataFrame([("extract.region", "globe"), ("attribution.short", "synthetic"), ("data.timerange", "2024-01")], "key string, value string")
    return Store(versions(spark, sf_dir), None, meta)


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same histories' ways, with two nodes each as members, and a third if the event's number is even."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("user_id").alias("osm_id"), "event_id")
    v = versions(spark, sf_dir).where("osm_type = 'way'").drop("members")
    node = lambda a: F.struct(F.lit("node").alias("type"), ((F.col("event_id") * a) % 50 * 3).alias("id"), F.lit("").alias("role"))
    members = F.when(F.col("event_id") % 2 == 0, F.array(node(7), node(11), node(13))).otherwise(F.array(node(7), node(11)))
    return v.join(e, ["osm_id", "ts"]).withColumn("members", members).select(*[c for c in v.columns], "members")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).where("osm_type = 'node'")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each order: its items' places in order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    point = F.struct("l_linenumber", (8 + (F.col("l_partkey") % 1000) / 1000.0).alias("lon"), (49 + (F.col("l_suppkey") % 100) / 100.0).alias("lat"))
    coords = F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return li.groupBy(F.col("l_orderkey").alias("osm_id")).agg(coords.alias("coords"))


VERSIONS_SQL = r"""
versions as (
  select case user_id % 3 when 0 then 'node' when 1 then 'way' else 'relation' end as osm_type, user_id as osm_id,
    row_number() over (partition by user_id order by ts, event_id) as version, event_type <> 'error' as visible, ts,
    cast(strftime(ts, '%Y%m%d') as bigint) as changeset_id, cast(event_id % 50 as int) as user_id, event_type as kind,
    regexp_extract(props, '\d+') as k, (event_id * 7919 % 3600000) * 1000 - 1800000000 as lon_e7,
    (event_id * 104729 % 1800000) * 1000 - 900000000 as lat_e7, event_id
  from events
), v as (select *, lead(ts) over (partition by osm_type, osm_id order by ts, version) as valid_to from versions)"""

POINTS_SQL = """
points as (
  select l_orderkey as osm_id, 8 + (l_partkey % 1000) / 1000.0::double as lon, 49 + (l_suppkey % 100) / 100.0::double as lat,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey % 1000, l_suppkey % 100) as i
  from lineitem
)"""
