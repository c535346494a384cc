"""Versions from a database: columns of model.VERSIONS, tags and members as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon import model

PLAIN = ("osm_type", "osm_id", "version", "visible", "ts", "changeset_id", "user_id", "lon_e7", "lat_e7")


def from_text(rows: DataFrame) -> DataFrame:
    """model.VERSIONS from plain columns and the texts `tags` (an object) and `members` (an array of objects)."""
    schema = rows.sparkSession.createDataFrame([], model.VERSIONS).schema
    tags = F.from_json("tags", "map<string, string>")
    members = F.from_json("members", f"array<{model.MEMBER}>")
    return rows.withColumn("tags", tags).withColumn("members", members).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_jdbc(spark: SparkSession, url: str, table: str = "versions", parts: int = 1, low: int = 0, high: int = 1 << 40, **options: str) -> DataFrame:
    """The table, read in `parts` ranges of osm_id at a time."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if parts > 1:
        reader = reader.options(partitionColumn="osm_id", numPartitions=str(parts), lowerBound=str(low), upperBound=str(high))
    return from_text(reader.load())
