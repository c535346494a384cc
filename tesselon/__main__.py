"""python -m tesselon --store PATH [--prefix NAME] [--props FILE]: a few figures of a store."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesselon.sources import connect


def main() -> None:
    spark = SparkSession.builder.appName("tesselon").getOrCreate()
    figures = lambda store: store.versions.groupBy("osm_type").agg(F.count(F.lit(1)).alias("versions"), F.min("ts").alias("first"), F.max("ts").alias("last")).orderBy("osm_type")
    connect.connect(spark, connect.arguments(), figures).show()


if __name__ == "__main__":
    main()
