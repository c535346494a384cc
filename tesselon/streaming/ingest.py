"""Versions as a stream: into a store, and counted by time as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon import model


def version_stream(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """New files under a path, as versions."""
    return spark.readStream.schema(model.VERSIONS).format(form).load(path)


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append versions to a table by type, each exactly once; by default what is there now, then stop."""
    writer = stream.writeStream.format("parquet").partitionBy("osm_type").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def edits_by_window(stream: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Edits and deletions for each type and stretch of time; edits later than `late` are left out."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("osm_type", F.window("at", length)).agg(F.count(F.lit(1)).alias("edits"), F.sum((~F.col("visible")).cast("long")).alias("deletions"))
