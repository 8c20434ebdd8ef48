"""Registered queries on the running service: ticks, counters, short lists, extents."""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tramline.operators import matching, priors, report, track
from tramline.plans.registry import query
from tramline.plans.roads import _FLAT, _NODES, _grid
from tramline.plans.telemetry import _ALL, LAT0, PAIRS, _base, _board, _rounded, _score, _sql
from tramline.profile import FIXTURE as P
from tramline.session import shared_dir
from tramline.sources import fixtures
from tramline.streaming.online import Ticks, counted, observed


@query(_sql("SELECT min(stop_lat) - 0.02::DOUBLE AS south, min(stop_lon) - 0.02::DOUBLE AS west, max(stop_lat) + 0.02::DOUBLE AS north, max(stop_lon) + 0.02::DOUBLE AS east, count(DISTINCT tr_id) AS vehicles FROM schedule"))
def fleet_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.bounds(fixtures.schedule(spark, sf_dir))


@query(_sql("SELECT count(speed) AS n, round(avg(speed), 6) AS mean, round(stddev_samp(speed), 6) AS std, min(speed) AS least, max(speed) AS largest, round(quantile_cont(speed, 0.25), 6) AS p25, round(quantile_cont(speed, 0.5), 6) AS p50, round(quantile_cont(speed, 0.75), 6) AS p75, round(quantile_cont(speed, 0.95), 6) AS p95 FROM traffic"))
def describe_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.describe(fixtures.traffic(spark, sf_dir), "speed"), 6, "mean", "std", "p25", "p50", "p75", "p95")


@query(_sql("SELECT round(max(abs(speed - floor(speed))), 9) AS largest_difference FROM traffic"))
def max_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.traffic(spark, sf_dir).withColumn("whole", F.floor("speed"))
    return _rounded(report.largest_difference(f, "speed", "whole"), 9, "largest_difference")


@query(_sql("SELECT (SELECT count(*) FROM traffic) AS records, (SELECT count(*) FROM traffic WHERE location_valid) AS valid, (SELECT count(DISTINCT tr_id) FROM traffic) AS vehicles, (SELECT max(ts) FROM traffic) AS last_ts, count(pred_s) AS predicted, count(*) - count(pred_s) AS not_predicted FROM ranked_board", *_ALL))
def service_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counters(fixtures.traffic(spark, sf_dir), _board(spark, sf_dir))


@query(_sql(f"SELECT tr_id, count(*) AS segments, count(*) FILTER (NOT near) AS fallbacks, round(100.0::DOUBLE * count(*) FILTER (NOT near) / count(*), 2) AS percent FROM (SELECT p.tr_id, EXISTS (SELECT 1 FROM nodes n WHERE {_FLAT} <= 60) AS near FROM traffic p) GROUP BY ROLLUP (tr_id)", _NODES))
def snap_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.traffic(spark, sf_dir).select(F.col("event_id").alias("point_id"), "tr_id", "lat", "lon")
    near = matching.nearest(f, _grid(spark)[0].withColumnRenamed("node_id", "place_id"), 55.75, 60.0).select("point_id", "place_id")
    return report.fallback_shares(f.join(near, "point_id", "left"), F.col("place_id").isNotNull())


@query(_sql("SELECT rank, tr_id, pred_s FROM ranked_board WHERE pred_s >= 120 ORDER BY rank LIMIT 8", *_ALL))
def top_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = _board(spark, sf_dir).where(F.col("pred_s") >= P.alert)
    return report.top(late.select("rank", "tr_id", "pred_s"), 8, "rank")


@query(_sql("SELECT tr_id, count(*) AS n FROM traffic GROUP BY 1 ORDER BY n DESC, tr_id LIMIT 25"))
def top_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top(fixtures.traffic(spark, sf_dir).groupBy("tr_id").agg(F.count("*").alias("n")), 25, F.desc("n"), "tr_id")


@query(_sql("SELECT DISTINCT t FROM points ORDER BY t"))
def label_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.label_times(_base(spark, sf_dir)[2])


@query(_sql("SELECT event_id, coalesce(CASE WHEN location_valid THEN speed END / 60.0::DOUBLE, 0) AS speed, heading / 360.0::DOUBLE AS heading FROM traffic"))
def scaled_statics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.traffic(spark, sf_dir).select("event_id", F.when(F.col("location_valid"), F.col("speed")).alias("speed"), "heading")
    return report.scaled(f, {"speed": 60.0, "heading": 360.0})


_CARRY = f"""WITH RECURSIVE {fixtures.SQL}, {_NODES},
spots AS (SELECT event_id, list({{'r': r, 'lat': lat, 'lon': lon}} ORDER BY r) AS near FROM (
  SELECT p.event_id, n.lat, n.lon, row_number() OVER (PARTITION BY p.event_id ORDER BY round({_FLAT}, 6), n.node_id) AS r FROM traffic p, nodes n WHERE {_FLAT} <= {P.route_snap}) WHERE r <= 8 GROUP BY 1),
seq AS (SELECT f.event_id, tr_id, row_number() OVER (PARTITION BY tr_id ORDER BY ts, f.event_id) AS rn, coalesce(near, []) AS near FROM traffic f LEFT JOIN spots s ON s.event_id = f.event_id),
walk AS (
  SELECT event_id, tr_id, rn, len(near) AS near, near[1].lat AS route_lat, near[1].lon AS route_lon FROM seq WHERE rn = 1
  UNION ALL
  SELECT event_id, tr_id, rn, len(near), CASE WHEN len(near) = 0 THEN plat ELSE best[1].lat END, CASE WHEN len(near) = 0 THEN plon ELSE best[1].lon END FROM (
    SELECT s.event_id, s.tr_id, s.rn, s.near, w.route_lat AS plat, w.route_lon AS plon,
      list_sort(list_transform(s.near, lambda c: {{'d': coalesce(round((c.lat - w.route_lat) * (c.lat - w.route_lat) + (c.lon - w.route_lon) * (c.lon - w.route_lon), 14), 0), 'r': c.r, 'lat': c.lat, 'lon': c.lon}})) AS best
    FROM walk w JOIN seq s ON s.tr_id = w.tr_id AND s.rn = w.rn + 1))
SELECT event_id AS point_id, route_lat, route_lon, CAST(near AS INT) AS near FROM walk"""


@query(_CARRY)
def on_route_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.traffic(spark, sf_dir).select(F.col("event_id").alias("point_id"), "tr_id", "ts", "lat", "lon")
    return matching.on_route(f, _grid(spark)[0].withColumnRenamed("node_id", "place_id"), 55.75, P.route_snap)


_SEGMENTS = f"""
seg AS (SELECT tr_id, ts, lat, lon, coalesce(lead(ts) OVER w, ts) AS n_ts, coalesce(lead(lat) OVER w, lat) AS n_lat, coalesce(lead(lon) OVER w, lon) AS n_lon FROM traffic WHERE location_valid WINDOW w AS (PARTITION BY tr_id ORDER BY ts, lat, lon)),
flat AS (SELECT tt_action_item_id, plan_s, ts, n_ts, (n_lon - lon) * 111320.0::DOUBLE * cos(radians(stop_lat)) AS dx, (n_lat - lat) * 111132.0::DOUBLE AS dy, (stop_lon - lon) * 111320.0::DOUBLE * cos(radians(stop_lat)) AS px, (stop_lat - lat) * 111132.0::DOUBLE AS py
  FROM schedule s JOIN seg USING (tr_id) WHERE n_ts >= plan_s - {P.match_window} AND ts <= plan_s + {P.match_window}),
along AS (SELECT *, least(greatest((px * dx + py * dy) / greatest(dx * dx + dy * dy, 1e-9::DOUBLE), 0), 1) AS f FROM flat),
passed AS (SELECT tt_action_item_id, ts, ts + f * (n_ts - ts) - plan_s AS delay FROM along WHERE sqrt(pow(px - f * dx, 2) + pow(py - f * dy, 2)) <= {P.match_radius} AND abs(ts + f * (n_ts - ts) - plan_s) <= {P.match_window}),
on_track AS (SELECT tt_action_item_id, round(delay, 6) AS delay FROM (SELECT *, row_number() OVER (PARTITION BY tt_action_item_id ORDER BY abs(delay), ts) AS r FROM passed) WHERE r = 1)"""


def _passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = matching.valid_fixes(fixtures.traffic(spark, sf_dir))
    return track.snapped_delays(fixes, fixtures.schedule(spark, sf_dir), P.match_radius, float(P.match_window))


@query(_sql("SELECT tt_action_item_id, delay AS est_delay_s FROM on_track", _SEGMENTS))
def segment_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_passed(spark, sf_dir), 6, "est_delay_s")


@query(_sql("SELECT s.tr_id, s.tt_action_item_id, s.plan_s, coalesce(o.delay, CAST(r.dt AS DOUBLE)) AS est_delay_s, CASE WHEN o.delay IS NOT NULL THEN 'track' WHEN r.dt IS NOT NULL THEN 'radius' END AS origin FROM schedule s LEFT JOIN on_track o ON o.tt_action_item_id = s.tt_action_item_id LEFT JOIN (SELECT tt_action_item_id, arg_min(dt, abs(dt) * 10000000000 + ts) AS dt FROM pairs GROUP BY 1) r ON r.tt_action_item_id = s.tt_action_item_id", LAT0, PAIRS, _SEGMENTS))
def refined_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matching.match_stops(fixtures.traffic(spark, sf_dir), fixtures.schedule(spark, sf_dir), P)
    return _rounded(track.refined_delays(matched, _passed(spark, sf_dir)), 6, "est_delay_s")


_KEEP = P.windows[-1] + P.match_window
#: The schedule moved on, so that arrivals are planned after the stream's last fix.
_LATER = 2 * 86_400
_NOW = fixtures.SQL.replace("% 2592000 AS BIGINT) AS plan_s", f"% 2592000 + {_LATER} AS BIGINT) AS plan_s").replace("traffic AS (", "traffic_all AS (", 1).split("schedule0 AS (")
_TICK = (
    f"WITH {_NOW[0]} traffic AS (SELECT * FROM traffic_all WHERE ts > (SELECT max(ts) FROM traffic_all) - {_KEEP}), schedule0 AS ({_NOW[1].split('points AS (')[0]}"
    f" points AS (SELECT tr_id AS sample_id, tr_id, (SELECT max(ts) FROM traffic) AS t, NULL::DOUBLE AS cur_dev_s FROM traffic GROUP BY tr_id HAVING (SELECT max(ts) FROM traffic) - max(ts) <= {P.active}),\n"
    + ",\n".join(_ALL) + "SELECT * FROM ranked_board"
)


def _ticks(spark: SparkSession, sf_dir: str, parts: int = 2) -> tuple[Ticks, list[StreamingQuery]]:
    """The fixes in `parts` stretches of time, each written, then taken by a run of the ticks that goes on from the last one's state."""
    s = fixtures.schedule(spark, sf_dir).withColumns({c: F.col(c) + _LATER for c in ("plan_s", "fact_s")})
    ticks = Ticks(s, priors.build_priors(s, P), P, _score(), _KEEP)
    f = fixtures.traffic(spark, sf_dir).select(*ticks.columns).withColumn("event_time", F.timestamp_seconds("ts"))
    cuts = f.agg(F.percentile_approx("ts", [k / parts for k in range(1, parts)])).first()[0] or []
    edges, runs = [None, *cuts, None], []
    for low, high in zip(edges, edges[1:], strict=False):
        part = f.where((F.lit(True) if low is None else F.col("ts") > low) & (F.lit(True) if high is None else F.col("ts") <= high))
        part.write.mode("append").parquet(f"{ticks.folder}/in")
        runs.append(ticks.start(spark.readStream.schema(f.schema).parquet(f"{ticks.folder}/in"), every=None))
        runs[-1].awaitTermination()
    return ticks, runs


@query(_TICK)
def online_tick_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board of the last of several ticks, whose history is the state of a streaming query that was stopped in between."""
    ticks, _ = _ticks(spark, sf_dir)
    return ticks.published(ticks.last).drop("sched_headway_s")


@query(_sql("SELECT count(*) AS records, count(*) FILTER (location_valid) AS valid FROM traffic"))
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a running stream counts on its way, in two runs from one checkpoint."""
    folder = f"{shared_dir(spark)}/counters-{uuid.uuid4().hex}"
    f, total = fixtures.traffic(spark, sf_dir).select("event_id", "tr_id", "location_valid"), Counter()
    for half in (0, 1):
        f.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{folder}/in")
        stream = counted(spark.readStream.schema(f.schema).parquet(f"{folder}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        total += observed(q)
    return spark.createDataFrame([(total["records"], total["valid"])], "records long, valid long")
