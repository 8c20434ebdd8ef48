"""Readers and writers of the file formats: CSV, Parquet, road and route JSON."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tramline import schemas
from tramline.functions.geo import stop_key, wkt_lat, wkt_lon
from tramline.functions.scalars import epoch_s, number


def _csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Columns by name, whatever their order in the file; those that the file lacks are null."""
    want = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    raw = spark.read.csv(path, header=True, sep=sep)
    return raw.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields))


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry with ts in epoch seconds; order is left to the windows that need it."""
    return _csv(spark, path, schemas.TRAFFIC).withColumn("ts", epoch_s(F.col("event_time")))


def with_stops(raw: DataFrame) -> DataFrame:
    """plan_s, fact_s (null where it can't be read), stop_lat, stop_lon and stop_key."""
    fact = epoch_s(F.col("time_fact_begin").try_cast("timestamp_ntz"))
    s = raw.withColumns({"plan_s": epoch_s(F.col("time_begin")), "fact_s": fact, "stop_lat": wkt_lat(F.col("geom")), "stop_lon": wkt_lon(F.col("geom"))})
    return s.withColumn("stop_key", stop_key(F.col("stop_lat"), F.col("stop_lon")))


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    return with_stops(_csv(spark, path, schemas.SCHEDULE))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    p = _csv(spark, path, schemas.POINTS)
    return p.withColumns({"t": epoch_s(F.col("T")), "target_s": epoch_s(F.col("target_time_begin")), "target_delay_s": number(F.col("target_delay_s"))})


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists, in whatever store it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(paths[-1])


def modified_ms(spark: SparkSession, path: str) -> int | None:
    """When a file was changed last, in whatever store it is; null if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getFileStatus(at).getModificationTime() if store.exists(at) else None


_SCANS: OrderedDict[tuple, DataFrame] = OrderedDict()


def cached_scan(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame], most: int = 4) -> DataFrame:
    """read(spark, path), cached until the file changes; beyond `most` tables the one asked for least lately is let go."""
    key = (id(spark), path, read.__qualname__, modified_ms(spark, path))
    if key not in _SCANS:
        _SCANS[key] = read(spark, path).cache()
    _SCANS.move_to_end(key)
    stale = [k for k in _SCANS if k[:3] == key[:3] and k != key]
    for k in [*stale, *list(_SCANS)[: max(0, len(_SCANS) - len(stale) - most)]]:
        if k in _SCANS:
            _SCANS.pop(k).unpersist()
    return _SCANS[key]


def newest(spark: SparkSession, folder: str, pattern: str = "roads_*.json") -> str | None:
    """The file of the folder that was changed last; of several the last by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    return files.agg(F.max(F.struct("modificationTime", "path"))["path"]).first()[0]


def read_roads(spark: SparkSession, *paths: str, by_line: bool = False) -> DataFrame:
    """Elements (nodes and ways) of road documents; an element that several documents have is kept once.

    A document is a file, or with by_line a line, so that a large file is read by many tasks.
    """
    docs = spark.read.schema(f"elements array<struct<{schemas.ELEMENTS.replace(' string', ':string').replace(' long', ':long').replace(' double', ':double').replace('nodes array', 'nodes:array').replace('tags map', 'tags:map')}>>").json(list(paths), multiLine=not by_line)
    return docs.select(F.explode("elements").alias("e")).select("e.*").dropDuplicates(["type", "id"])


def write_roads(elements: DataFrame, path: str, most: int = 1000) -> None:
    """Road documents of at most about `most` elements, one to a line."""
    part = F.pmod(F.xxhash64("type", "id"), F.lit(max(1, -(-elements.count() // most))))
    docs = elements.groupBy(part.alias("part")).agg(F.collect_list(F.struct(*elements.columns)).alias("elements"))
    docs.select(F.to_json(F.struct("elements")).alias("value")).write.mode("overwrite").text(path)


#: The classes of roads that vehicles use.
HIGHWAYS = r"^(motorway|trunk|primary|secondary|tertiary|unclassified|residential|living_street|service)(_link)?$"


def drivable(elements: DataFrame) -> DataFrame:
    """All nodes, and the ways of drivable classes."""
    return elements.where((F.col("type") == "node") | F.col("tags")["highway"].rlike(HIGHWAYS))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """Lines of two vertices or more of a GeoJSON file: tr_id, pos, lat, lon."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<tr_id:long>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).where("f.geometry.type = 'LineString' AND size(f.geometry.coordinates) >= 2")
    return f.select(F.col("f.properties.tr_id").alias("tr_id"), F.posexplode("f.geometry.coordinates").alias("pos", "c")).select("tr_id", "pos", F.get("c", F.lit(1)).alias("lat"), F.get("c", F.lit(0)).alias("lon"))


def read_route_lines(spark: SparkSession, path: str) -> DataFrame:
    """read_routes() of files with a feature to a line, as write_routes() leaves them."""
    schema = "geometry struct<type:string,coordinates:array<array<double>>>, properties struct<tr_id:long>"
    f = spark.read.schema(schema).json(path).where("geometry.type = 'LineString' AND size(geometry.coordinates) >= 2")
    return f.select(F.col("properties.tr_id").alias("tr_id"), F.posexplode("geometry.coordinates").alias("pos", "c")).select("tr_id", "pos", F.get("c", F.lit(1)).alias("lat"), F.get("c", F.lit(0)).alias("lon"))


def write_routes(routes: DataFrame, path: str) -> None:
    """One GeoJSON feature a line."""
    routes.select("feature").write.mode("overwrite").text(path)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """A submission template: semicolons, sample_id first."""
    return spark.read.csv(path, header=True, sep=";")


def write_submission(predictions: DataFrame, template: DataFrame, path: str) -> None:
    """Predictions for every sample of the template; raises if one is missing."""
    if not template.join(predictions, "sample_id", "left_anti").isEmpty():
        raise ValueError("samples without a prediction")
    template.select("sample_id").join(predictions.select("sample_id", "pred_s"), "sample_id").write.mode("overwrite").csv(path, header=True, sep=";")


def cached_graph(spark: SparkSession, json_path: str, cache_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and ways from Parquet copies, which are made from the document on first use and again where it is newer."""
    from tramline.operators import graph

    made = modified_ms(spark, f"{cache_path}/ways/_SUCCESS")
    if made is None or (modified_ms(spark, json_path) or 0) > made:
        e = read_roads(spark, json_path).cache()
        ways, nodes = graph.way_nodes(e), graph.nodes_of(e)
        nodes.write.mode("overwrite").parquet(f"{cache_path}/nodes")
        graph.edges_of(ways, nodes).write.mode("overwrite").parquet(f"{cache_path}/edges")
        ways.write.mode("overwrite").parquet(f"{cache_path}/ways")
        e.unpersist()
    return tuple(spark.read.parquet(f"{cache_path}/{n}") for n in ("nodes", "edges", "ways"))
