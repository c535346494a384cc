"""The engine's table on disk: histories filed by the grid, so that a scan of an area reads only the cells it may touch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon import model
from tesselon.functions import grid
from tesselon.operators.members import ENTITY
from tesselon.operators.pipeline import Store


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; in one of its own on a local master, where that may be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tesselon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def filed(boxes: DataFrame) -> DataFrame:
    """Rows with min_lon, min_lat, max_lon, max_lat (integers) and the level and cell they are filed under."""
    corners = [F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    out = boxes.withColumn("level", grid.insert_level_column(*corners))
    return out.withColumn("cell_id", grid.cell_id_column(F.col("level"), corners[0], corners[1]))


def histories(versions: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Versions with their history's statistics: the box of all visible versions (of the visible versions of all nodes of ways, and of relations with their ways), all tag keys, level and cell. What has no place has neither box nor cell."""
    own = versions.where("visible and lon_e7 is not null").select(*ENTITY, "lon_e7", "lat_e7")
    if nodes is not None:
        refs = versions.where("members is not null").select(*ENTITY, F.explode("members").alias("m"))
        to_nodes = refs.where("m.type = 'node'").select(*ENTITY, F.col("m.id").alias("node")).distinct()
        ways = to_nodes.where("osm_type = 'way'").select(F.col("osm_id").alias("way"), "node")
        # relations reach as far as the ways that are ever their members
        through = refs.where("m.type = 'way'").select(*ENTITY, F.col("m.id").alias("way")).distinct().join(ways, "way").select(*ENTITY, "node").distinct()
        places = nodes.where("osm_type = 'node' and visible and lon_e7 is not null").select(F.col("osm_id").alias("node"), "lon_e7", "lat_e7")
        own = own.union(to_nodes.union(through).join(places, "node").select(*ENTITY, "lon_e7", "lat_e7"))
    box = own.groupBy(*ENTITY).agg(F.min("lon_e7").alias("min_lon"), F.min("lat_e7").alias("min_lat"), F.max("lon_e7").alias("max_lon"), F.max("lat_e7").alias("max_lat"))
    keys = versions.select(*ENTITY, F.explode(F.map_keys("tags")).alias("key")).groupBy(*ENTITY).agg(F.array_sort(F.collect_set("key")).alias("tag_keys"))
    return filed(versions.join(box, ENTITY, "left")).join(keys, ENTITY, "left").withColumn("tag_keys", F.coalesce("tag_keys", F.array().cast("array<string>")))


def write_store(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per type and level, rows in order of cells: scans prune folders, and row groups by their least and greatest cell."""
    table.repartitionByRange("osm_type", "level", "cell_id").sortWithinPartitions("osm_type", "level", "cell_id").write.mode(mode).partitionBy("osm_type", "level").parquet(path)


def read_store(spark: SparkSession, path: str, box=None) -> DataFrame:
    """The table, or the rows whose history may touch a box; both tests reach the scan."""
    table = spark.read.parquet(path)
    if box is None:
        return table
    return table.where(grid.touching(box))


def open_store(spark: SparkSession, path: str, prefix: str = "") -> Store:
    """Tables <prefix_>versions, <prefix_>nodes (if there) and <prefix_>metadata (if there) under a folder; a missing versions table fails at once.

    Members are looked up among the ways of the one and the nodes of the other; without a table of nodes only if the versions
    hold some member list (one row tells).
    """
    name = lambda t: f"{path}/{prefix + '_' if prefix else ''}{t}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def there(t: str) -> bool:
        p = hadoop(name(t))
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    if not there("versions"):
        raise FileNotFoundError(f"there is no table {name('versions')}")
    versions = spark.read.parquet(name("versions"))
    members, columns = None, model.VERSION_COLUMNS
    if there("nodes"):
        members = versions.where("osm_type = 'way'").select(*columns).unionByName(spark.read.parquet(name("nodes")).select(*columns))
    elif not versions.where("osm_type <> 'node' and members is not null").limit(1).isEmpty():
        members = versions.where("osm_type <> 'relation'").select(*columns)
    return Store(versions, members, spark.read.parquet(name("metadata")) if there("metadata") else None)


def empty_versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], model.VERSIONS)
