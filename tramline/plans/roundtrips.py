"""Registered queries that write the given tables in a file format and read them back, and on tracks' directions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import app, graph, matching, track
from tramline.operators.scan import Buckets
from tramline.plans.registry import query
from tramline.plans.roads import _roads_sql
from tramline.plans.telemetry import TARGET, _rounded, _sql
from tramline.profile import FIXTURE as P
from tramline.session import shared_dir
from tramline.sources import files, fixtures, ndtp


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(_sql("SELECT tr_id, unit_id, ts, lat, lon, speed, heading, location_valid FROM traffic"))
def src_telemetry_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry as CSV, its columns in another order, read from the first place that exists."""
    at = _folder(spark, "telemetry")
    f = fixtures.traffic(spark, sf_dir).withColumn("event_time", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss"))
    f.select("location_valid", "lon", "lat", "unit_id", "heading", "speed", "tr_id", "event_time").write.csv(at, header=True)
    back = files.read_traffic(spark, files.first_existing(spark, f"{at}-other", at))
    return back.select("tr_id", "unit_id", "ts", "lat", "lon", "speed", "heading", "location_valid")


@query(_sql("SELECT CAST(g.sample_id AS VARCHAR) AS sample_id, g.tr_id, g.t, target_stop_id, target_s, cur_dev_s, CASE WHEN g.sample_id % 7 <> 0 THEN CAST(dev_s AS DOUBLE) END AS target_delay_s FROM target g JOIN points p ON p.sample_id = g.sample_id JOIN schedule s ON s.tt_action_item_id = g.target_stop_id", TARGET))
def src_points_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points as CSV, some labels not numbers."""
    f, s = fixtures.traffic(spark, sf_dir), fixtures.schedule(spark, sf_dir)
    p = fixtures.points(f)
    t = matching.target_stop(p, s, P).join(p.select("sample_id", "cur_dev_s"), "sample_id").join(s.select(F.col("tt_action_item_id").alias("target_stop_id"), "dev_s"), "target_stop_id")
    at, time = _folder(spark, "points"), lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    label = F.when(F.col("sample_id") % 7 == 0, F.lit("unknown")).otherwise(F.col("dev_s").cast("string"))
    t.select("sample_id", "tr_id", time("t").alias("T"), "target_stop_id", time("target_s").alias("target_time_begin"), "cur_dev_s", label.alias("target_delay_s")).write.csv(at, header=True)
    return files.read_points(spark, at).select("sample_id", "tr_id", "t", "target_stop_id", "target_s", "cur_dev_s", "target_delay_s")


@query(_sql("SELECT CAST(sample_id AS VARCHAR) AS sample_id, CAST(cur_dev_s / 4 AS DOUBLE) AS pred_s FROM points"))
def submission_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for every sample of a template with semicolons, written and read."""
    at = _folder(spark, "submission")
    p = fixtures.points(fixtures.traffic(spark, sf_dir))
    p.select("sample_id", F.lit(None).cast("string").alias("pred_s")).write.csv(f"{at}/template", header=True, sep=";")
    said = p.select(F.col("sample_id").cast("string").alias("sample_id"), (F.col("cur_dev_s") / 4).alias("pred_s"))
    files.write_submission(said, files.read_template(spark, f"{at}/template"), f"{at}/out")
    return files.read_template(spark, f"{at}/out").select("sample_id", F.col("pred_s").cast("double").alias("pred_s"))


@query(_sql("SELECT tr_id, CAST(row_number() OVER (PARTITION BY tr_id ORDER BY plan_s, tt_action_item_id) - 1 AS INT) AS pos, round(stop_lat, 6) AS lat, round(stop_lon, 6) AS lon FROM schedule QUALIFY count(*) OVER (PARTITION BY tr_id) >= 2"))
def routes_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes as GeoJSON, a feature to a line, read back vertex by vertex."""
    at = _folder(spark, "routes")
    files.write_routes(app.routes(fixtures.schedule(spark, sf_dir)), at)
    return _rounded(files.read_route_lines(spark, at), 6, "lat", "lon")


def foot_paths(e: DataFrame) -> DataFrame:
    """A foot path from each node, with ids that no way of fixtures.road_elements has: those of days are not negative, those of streets are small."""
    return e.where("type = 'node'").select(F.lit("way").alias("type"), (-F.col("id") - 10**15).alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.array(F.col("id"), F.col("id") + 41).alias("nodes"), F.create_map(F.lit("highway"), F.lit("footway")).alias("tags"))


@query(_roads_sql(" SELECT u, v, round(length_m, 3) AS length_m FROM redge"))
def roads_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road documents with foot paths, written in a folder named by the box around them, read, cut to drivable ways."""
    e = fixtures.road_elements(spark, sf_dir)
    box = e.agg(F.coalesce(geo.bbox_key(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")), F.lit("none"))).first()[0]
    at = f"{_folder(spark, 'roads')}/roads_{box}"
    files.write_roads(e.unionByName(foot_paths(e)), at)
    found = files.drivable(files.read_roads(spark, at, by_line=True))
    nodes = graph.nodes_of(found)
    return _rounded(graph.edges_of(graph.way_nodes(found), nodes), 3, "length_m")


_BEARING = """
pair AS (SELECT event_id, heading, lat, lon, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM traffic WHERE location_valid WINDOW w AS (PARTITION BY tr_id ORDER BY ts, event_id)),
way AS (SELECT event_id, heading, degrees(atan2(sin(radians(lon - p_lon)) * cos(radians(lat)), cos(radians(p_lat)) * sin(radians(lat)) - sin(radians(p_lat)) * cos(radians(lat)) * cos(radians(lon - p_lon)))) AS d FROM pair WHERE p_lat IS NOT NULL AND (lat <> p_lat OR lon <> p_lon)),
b AS (SELECT event_id, heading, d - 360 * floor(d / 360) AS bearing FROM way)"""


@query(_sql("SELECT event_id, round(bearing, 4) AS bearing, round(heading - bearing + 180 - 360 * floor((heading - bearing + 180) / 360) - 180, 4) AS turn FROM b", _BEARING))
def track_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction of each step and how far the heading is off, of fixes at plausible places."""
    f = matching.valid_fixes(fixtures.traffic(spark, sf_dir)).where(geo.in_world(F.col("lat"), F.col("lon")))
    b = Buckets(f, "tr_id", "ts", ["event_id"])
    place = F.struct("ts", "event_id", "lat", "lon")
    t = b.carried(b.df.withColumn("_own", F.lag(place).over(b.within)), {"_end": F.max(place)}, {"_before": F.lag("_end").over(b.over)})
    p = F.coalesce("_own", "_before")
    t = t.withColumns({"p_lat": p["lat"], "p_lon": p["lon"]}).where("p_lat IS NOT NULL AND (lat <> p_lat OR lon <> p_lon)")
    t = t.withColumn("bearing", geo.bearing_deg(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")))
    return t.select("event_id", F.round("bearing", 4).alias("bearing"), F.round(geo.angle_between(F.col("bearing"), F.col("heading")), 4).alias("turn"))


_SMOOTH = f"""WITH RECURSIVE {fixtures.SQL},
o AS (SELECT event_id, tr_id, speed, row_number() OVER (PARTITION BY tr_id ORDER BY ts, speed) AS rn FROM traffic),
m AS (SELECT event_id, tr_id, rn, speed AS m FROM o WHERE rn = 1 UNION ALL SELECT o.event_id, o.tr_id, o.rn, (m.m + o.speed) / 2 FROM m JOIN o ON o.tr_id = m.tr_id AND o.rn = m.rn + 1)
SELECT event_id, round(sqrt(least(greatest(m, 0), 300)), 9) AS smooth_root FROM m"""


@query(_SMOOTH)
def smoothed_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential mean of each vehicle's speeds over its whole history; its root, as halves of hundredths lie between two roundings."""
    f = fixtures.traffic(spark, sf_dir).select("event_id", "tr_id", "ts", "speed")
    return track.smoothed(f, "tr_id", "ts", "speed", 0.0, 300.0).select("event_id", F.round(F.sqrt("smooth"), 9).alias("smooth_root"))


@query(_sql("SELECT unit_id, ts, CASE WHEN location_valid THEN 1 ELSE -1 END * floor(lat * 1e7::DOUBLE) / 1e7::DOUBLE AS lat, CASE WHEN location_valid THEN 1 ELSE -1 END * floor(lon * 1e7::DOUBLE) / 1e7::DOUBLE AS lon, location_valid, floor(speed) AS speed FROM traffic"))
def framed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a vehicle's day as one piece of a stream, with other bytes between them."""
    f = ndtp.frames_of(fixtures.traffic(spark, sf_dir)).select("tr_id", F.floor(F.col("ts") / 86_400).alias("day"), "ts", "frame")
    pieces = f.groupBy("tr_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", F.hex("frame").alias("frame")))).alias("x"))  # a vehicle's day
    whole = F.unhex(F.concat(F.lit("007E41"), F.array_join(F.transform("x", lambda x: x["frame"]), "7E007E7E41"), F.lit("7E")))
    return ndtp.decode(pieces.select(whole.alias("frame"))).select("unit_id", "ts", "lat", "lon", "location_valid", "speed")
