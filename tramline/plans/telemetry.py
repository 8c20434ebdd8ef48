"""Registered queries on tracks and schedules, each with the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions import geo, scalars
from tramline.operators import app, clean, features, matching, priors, track, trips
from tramline.plans.registry import query
from tramline.profile import FIXTURE as P
from tramline.sources import files, fixtures


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([fixtures.SQL, *ctes]) + body


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


TARGET = f"""
target AS (
  SELECT sample_id, p.tr_id, t, arg_min(tt_action_item_id, plan_s * 100000 + tt_action_item_id) AS target_stop_id, min(plan_s) AS target_s
  FROM points p JOIN schedule s ON s.tr_id = p.tr_id AND plan_s > t + {P.horizon_lo} AND plan_s <= t + {P.horizon_hi} GROUP BY 1, 2, 3)"""
LAT0 = "origins AS (SELECT tr_id, median(stop_lat) AS lat0, median(stop_lon) AS lon0 FROM schedule GROUP BY 1)"
_PLANAR = "sqrt(pow(({a}lat - {b}lat) * 111132.0::DOUBLE, 2) + pow(({a}lon - {b}lon) * 111320.0::DOUBLE * cos(radians(lat0)), 2))"
PAIRS = f"""
pairs AS (
  SELECT DISTINCT s.tr_id, s.tt_action_item_id, s.plan_s, f.ts, f.ts - s.plan_s AS dt
  FROM schedule s JOIN origins o ON o.tr_id = s.tr_id JOIN traffic f ON f.tr_id = s.tr_id AND f.location_valid AND abs(f.ts - s.plan_s) <= {P.match_window}
  WHERE {_PLANAR.format(a="f.", b="s.stop_")} <= {P.match_radius})"""
TRIPS = f"""
gaps AS (SELECT *, plan_s - lag(plan_s) OVER w AS gap, row_number() OVER w - 1 AS route_pos FROM schedule WINDOW w AS (PARTITION BY tr_id ORDER BY plan_s, tt_action_item_id)),
opened AS (SELECT *, CAST(sum(CASE WHEN gap <= {P.trip_gap} THEN 0 ELSE 1 END) OVER (PARTITION BY tr_id ORDER BY plan_s, tt_action_item_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip_id FROM gaps),
trips AS (
  SELECT *, CAST(gap AS DOUBLE) AS planned_gap_prev_s, row_number() OVER (PARTITION BY tr_id, trip_id ORDER BY plan_s, tt_action_item_id) - 1 AS idx_in_trip,
         count(*) OVER (PARTITION BY tr_id, trip_id) AS n_stops_in_trip, plan_s - min(plan_s) OVER (PARTITION BY tr_id, trip_id) AS run_from_trip_start_s FROM opened)"""
PRIORS = f"""
priors AS (
  SELECT stop_key, count(*) AS prior_n, CAST(sum(fact_s - plan_s) AS BIGINT) AS prior_sum, CAST(median(fact_s - plan_s) AS DOUBLE) AS prior_median
  FROM schedule WHERE abs(fact_s - plan_s) <= {P.prior_cut} GROUP BY 1)"""
DEVIATION = f"""
seen AS (
  SELECT p.sample_id, p.t, m.tt_action_item_id, m.plan_s, arg_min(m.dt, abs(m.dt) * 10000000000 + m.ts) AS delay
  FROM points p JOIN pairs m ON m.tr_id = p.tr_id AND m.ts <= p.t AND m.plan_s + {P.plan_lead} <= p.t GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY plan_s DESC, tt_action_item_id DESC) AS r FROM seen),
deviation AS (
  SELECT p.sample_id, CAST(max(delay) FILTER (r = 1) AS DOUBLE) AS est_dev_last,
         CAST(max(delay) FILTER (r = 1) - max(delay) FILTER (r = 2) AS DOUBLE) AS est_dev_slope,
         CAST(sum(delay) FILTER (r <= 3) AS DOUBLE) / count(delay) FILTER (r <= 3) AS est_dev_mean3,
         CASE WHEN count(delay) FILTER (r <= 5) > 1 THEN sqrt(CAST(count(delay) FILTER (r <= 5) * sum(delay * delay) FILTER (r <= 5) - pow(sum(delay) FILTER (r <= 5), 2) AS DOUBLE)) / count(delay) FILTER (r <= 5) END AS est_dev_std5,
         count(delay) FILTER (abs(delay) <= {P.matched_short}) AS n_matched_30m, count(delay) AS n_matched_60m,
         CAST(max(p.t) - max(plan_s) FILTER (r = 1) AS DOUBLE) AS time_since_match_s
  FROM points p LEFT JOIN ranked k ON k.sample_id = p.sample_id GROUP BY 1)"""
STEPS = """
xy AS (SELECT f.*, (lat - lat0) * 111132.0::DOUBLE AS y, (lon - lon0) * 111320.0::DOUBLE * cos(radians(lat0)) AS x FROM traffic f LEFT JOIN origins o ON o.tr_id = f.tr_id WHERE location_valid),
steps AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM xy WINDOW w AS (PARTITION BY tr_id ORDER BY ts, lat, lon)),
paths AS (SELECT *, sum(step) OVER (PARTITION BY tr_id ORDER BY ts, lat, lon ROWS UNBOUNDED PRECEDING) AS path FROM steps)"""


def _window_sql() -> str:
    parts = []
    for w, n in zip(P.windows, P.window_names, strict=True):
        f = f"FILTER (f.ts > p.t - {w})"
        a, b = f"arg_min(struct_pack(x := x, y := y), path) {f}", f"arg_max(struct_pack(x := x, y := y), path) {f}"
        parts.append(
            f"avg(speed) {f} AS speed_mean_{n}, CASE WHEN count(speed) {f} > 1 THEN stddev_pop(speed) {f} END AS speed_std_{n}, max(speed) {f} AS speed_max_{n}, count(speed) {f} AS npts_{n}, "
            f"avg(CASE WHEN speed < {P.idle_speed} THEN 1 ELSE 0 END) {f} AS idle_frac_{n}, CASE WHEN count(speed) {f} > 1 THEN max(path) {f} - min(path) {f} END AS travel_m_{n}, "
            f"CASE WHEN count(speed) {f} > 1 THEN sqrt(pow(({b}).x - ({a}).x, 2) + pow(({b}).y - ({a}).y, 2)) END AS disp_m_{n}"
        )
    return f"windows AS (SELECT p.sample_id, {', '.join(parts)} FROM points p LEFT JOIN paths f ON f.tr_id = p.tr_id AND f.ts <= p.t AND f.ts > p.t - {max(P.windows)} AND f.speed IS NOT NULL GROUP BY 1)"


WINDOWS = _window_sql()
LAST_FIX = "lastfix AS (SELECT p.sample_id, p.t, f.ts AS fix_ts, f.lat AS lat, f.lon AS lon, f.speed AS speed FROM points p ASOF LEFT JOIN (SELECT * FROM traffic WHERE location_valid) f ON f.tr_id = p.tr_id AND p.t >= f.ts)"
RATE = "rates AS (SELECT p.sample_id, CAST(sum(CASE WHEN location_valid THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS valid_rate_all FROM points p JOIN traffic f ON f.tr_id = p.tr_id AND f.ts <= p.t GROUP BY 1)"


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = fixtures.traffic(spark, sf_dir)
    return f, fixtures.schedule(spark, sf_dir), fixtures.points(f)


@query(_sql("SELECT tr_id, count(*) AS n, count(*) FILTER (location_valid) AS n_valid, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(speed_c) AS BIGINT) AS speed_sum_c FROM traffic GROUP BY 1"))
def src_telemetry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.traffic(spark, sf_dir)
    return f.groupBy("tr_id").agg(F.count("*").alias("n"), F.count_if("location_valid").alias("n_valid"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("speed_c").alias("speed_sum_c"))


@query(_sql("SELECT tt_action_item_id, round(stop_lat, 6) AS lat, round(stop_lon, 6) AS lon, CASE WHEN tt_action_item_id % 7 = 0 THEN NULL ELSE fact_s END AS fact_s FROM schedule"))
def src_schedule_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.schedule(spark, sf_dir)
    text = s.select(
        "tt_action_item_id", "tr_id", F.timestamp_seconds("plan_s").cast("timestamp_ntz").alias("time_begin"),
        F.when(F.col("tt_action_item_id") % 7 == 0, "none").otherwise(scalars.iso_time(F.col("fact_s"))).alias("time_fact_begin"),
        F.format_string("POINT (%.8f %.8f)", "stop_lon", "stop_lat").alias("geom"),
    )
    back = files.with_stops(text)
    return back.select("tt_action_item_id", F.round("stop_lat", 6).alias("lat"), F.round("stop_lon", 6).alias("lon"), "fact_s")


@query(_sql("SELECT * FROM priors", PRIORS))
def priors_by_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priors.build_priors(fixtures.schedule(spark, sf_dir), P)


_LOO = """SELECT tt_action_item_id, CASE WHEN prior_n > 0 THEN prior_n - 1 END AS prior_n, CASE WHEN prior_n > 0 THEN prior_sum - dev_s END AS prior_sum,
 CASE WHEN prior_n > 1 THEN CAST(prior_sum - dev_s AS DOUBLE) / (prior_n - 1) END AS prior_mean, CASE WHEN prior_n IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS prior_known
 FROM schedule LEFT JOIN priors USING (stop_key)"""


@query(_sql(_LOO, PRIORS))
def priors_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.schedule(spark, sf_dir)
    return priors.attach_priors(s, priors.build_priors(s, P), "dev_s").select("tt_action_item_id", "prior_n", "prior_sum", "prior_mean", "prior_known")


@query(_sql("SELECT s.tt_action_item_id, CAST(p.prior_sum AS DOUBLE) / p.prior_n AS prior_mean, CASE WHEN p.prior_n IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS prior_known FROM schedule s LEFT JOIN (SELECT * FROM priors WHERE prior_n % 2 = 0) p USING (stop_key)", PRIORS))
def prior_known_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.schedule(spark, sf_dir)
    return priors.attach_priors(s, priors.build_priors(s, P).where("prior_n % 2 = 0")).select("tt_action_item_id", "prior_mean", "prior_known")


@query(_sql("SELECT tr_id, trip_id, count(*) AS n_stops, min(plan_s) AS first_plan, max(plan_s) AS last_plan FROM trips GROUP BY 1, 2", TRIPS))
def trips_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.with_trips(fixtures.schedule(spark, sf_dir), P).groupBy("tr_id", "trip_id").agg(F.count("*").alias("n_stops"), F.min("plan_s").alias("first_plan"), F.max("plan_s").alias("last_plan"))


@query(_sql("SELECT tt_action_item_id, trip_id, CAST(route_pos AS BIGINT) AS stops_before_target, planned_gap_prev_s, CAST(idx_in_trip AS BIGINT) AS idx_in_trip, n_stops_in_trip, CAST(n_stops_in_trip - idx_in_trip AS BIGINT) AS stops_left_in_trip, run_from_trip_start_s FROM trips", TRIPS))
def trip_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trips.with_trips(fixtures.schedule(spark, sf_dir), P)
    long = {c: F.col(c).cast("long") for c in ("stops_before_target", "idx_in_trip", "stops_left_in_trip")}
    return t.withColumns(long).select("tt_action_item_id", "trip_id", "stops_before_target", "planned_gap_prev_s", "idx_in_trip", "n_stops_in_trip", "stops_left_in_trip", "run_from_trip_start_s")


@query(_sql("SELECT * FROM target", TARGET))
def target_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, p = _base(spark, sf_dir)
    return matching.target_stop(p, s, P)


@query(_sql("SELECT * FROM target", TARGET))
def target_stop_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, p = _base(spark, sf_dir)
    return matching.target_stop_asof(p, s, P)


@query(_sql(f"SELECT sample_id, p.tr_id, t, x.tt_action_item_id AS target_stop_id, x.plan_s AS target_s FROM points p, LATERAL (SELECT tt_action_item_id, plan_s FROM schedule s WHERE s.tr_id = p.tr_id AND plan_s > t + {P.horizon_lo} AND plan_s <= t + {P.horizon_hi} ORDER BY plan_s, tt_action_item_id LIMIT 1) x"))
def target_stop_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, p = _base(spark, sf_dir)
    # A point meets the stops of the two buckets that its horizon touches, and the first of them is kept without a sort.
    width = P.horizon_hi - P.horizon_lo
    return spark.sql(
        """SELECT sample_id, tr_id, t, x.id AS target_stop_id, x.plan_s AS target_s FROM (
             SELECT sample_id, tr_id, t, min(x) AS x FROM (
               SELECT sample_id, tr_id, t, b FROM {points}, LATERAL explode(sequence(floor((t + :lo + 1) / :width), floor((t + :hi) / :width))) AS e(b)) p, LATERAL (
               SELECT struct(plan_s, tt_action_item_id AS id) AS x FROM {schedule} s
               WHERE s.tr_id = p.tr_id AND floor(plan_s / :width) = p.b AND plan_s > t + :lo AND plan_s <= t + :hi) GROUP BY 1, 2, 3)""",
        args={"lo": P.horizon_lo, "hi": P.horizon_hi, "width": width}, points=p, schedule=s,
    )


@query(_sql("SELECT s.tr_id, s.tt_action_item_id, s.plan_s, arg_min(dt, abs(dt) * 10000000000 + ts) AS est_delay_s, CAST(CASE WHEN count(dt) > 0 THEN 1 ELSE 0 END AS INT) AS matched FROM schedule s LEFT JOIN pairs m ON m.tt_action_item_id = s.tt_action_item_id GROUP BY 1, 2, 3", LAT0, PAIRS))
def stop_match_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s, _ = _base(spark, sf_dir)
    return matching.match_stops(f, s, P).select("tr_id", "tt_action_item_id", "plan_s", "est_delay_s", "matched")


@query(_sql("SELECT tr_id, count(*) AS unmatched FROM schedule s WHERE NOT EXISTS (SELECT 1 FROM pairs m WHERE m.tt_action_item_id = s.tt_action_item_id) GROUP BY 1", LAT0, PAIRS))
def stop_match_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s, _ = _base(spark, sf_dir)
    return s.join(matching.match_pairs(f, s, P), "tt_action_item_id", "left_anti").groupBy("tr_id").agg(F.count("*").alias("unmatched"))


@query(_sql("SELECT sample_id, fix_ts, lat, lon, speed, CAST(t - fix_ts AS BIGINT) AS age_last_s FROM lastfix", LAST_FIX))
def asof_last_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _, p = _base(spark, sf_dir)
    return matching.last_fix(p, f).select("sample_id", F.col("fix.ts").alias("fix_ts"), "fix.lat", "fix.lon", "fix.speed", (F.col("t") - F.col("fix.ts")).alias("age_last_s"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s, p = _base(spark, sf_dir)
    origin = s.groupBy("tr_id").agg(F.median("stop_lat").alias("lat0"), F.median("stop_lon").alias("lon0"))
    return features.window_features(p, f, origin, P)


_SPEED = [f"{c}_{n}" for n in P.window_names for c in ("speed_mean", "speed_std", "speed_max", "npts", "idle_frac")]
_PATH = [f"{c}_{n}" for n in P.window_names for c in ("travel_m", "disp_m")]


def _round_list(columns: list[str], places: int) -> str:
    return ", ".join(c if "npts" in c else f"round({c}, {places}) AS {c}" for c in columns)


@query(_sql(f"SELECT sample_id, {_round_list(_SPEED, 6)} FROM windows", LAT0, STEPS, WINDOWS))
def window_speed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_windows(spark, sf_dir).select("sample_id", *_SPEED), 6, *(c for c in _SPEED if "npts" not in c))


@query(_sql(f"SELECT sample_id, {_round_list(_PATH, 3)} FROM windows", LAT0, STEPS, WINDOWS))
def window_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_windows(spark, sf_dir).select("sample_id", *_PATH), 3, *_PATH)


@query(_sql("SELECT sample_id, round(valid_rate_all, 9) AS valid_rate_all FROM rates", RATE))
def valid_rate_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_windows(spark, sf_dir).select("sample_id", "valid_rate_all"), 9, "valid_rate_all")


def _deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s, p = _base(spark, sf_dir)
    return features.deviation_features(p, f, s, P)


@query(_sql("SELECT sample_id, est_dev_last, est_dev_slope, round(est_dev_mean3, 6) AS est_dev_mean3, round(est_dev_std5, 6) AS est_dev_std5 FROM deviation", LAT0, PAIRS, DEVIATION))
def deviation_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_deviation(spark, sf_dir).select("sample_id", "est_dev_last", "est_dev_slope", "est_dev_mean3", "est_dev_std5"), 6, "est_dev_mean3", "est_dev_std5")


@query(_sql(f"SELECT d.sample_id, n_matched_30m, n_matched_60m, time_since_match_s, count(k.plan_s) FILTER (k.plan_s >= k.t - {P.matched_short}) AS offline_30m, count(k.plan_s) FILTER (k.plan_s >= k.t - {P.matched_long}) AS offline_60m FROM deviation d LEFT JOIN ranked k ON k.sample_id = d.sample_id GROUP BY 1, 2, 3, 4", LAT0, PAIRS, DEVIATION))
def deviation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    f, s, p = _base(spark, sf_dir)
    offline = features.deviation_features(p, f, s, replace(P, counting="offline")).select("sample_id", F.col("n_matched_30m").alias("offline_30m"), F.col("n_matched_60m").alias("offline_60m"))
    return _deviation(spark, sf_dir).select("sample_id", "n_matched_30m", "n_matched_60m", "time_since_match_s").join(offline, "sample_id")


_FULL = f"""SELECT p.sample_id, p.t, CAST(p.tr_id AS VARCHAR) AS tr_id, CAST(target_stop_id AS VARCHAR) AS target_stop_id, p.cur_dev_s, target_s - p.t AS horizon_s, CAST(p.t - fix_ts AS DOUBLE) AS age_last_s, l.speed AS speed_last,
 {_round_list(_SPEED, 6)}, {_round_list(_PATH, 3)}, {', '.join(f'round(travel_m_{n} / {w}, 6) AS avg_v_{n}' for w, n in zip(P.windows, P.window_names, strict=True))},
 round(valid_rate_all, 6) AS valid_rate_all, CAST(route_pos AS BIGINT) AS stops_before_target, planned_gap_prev_s, CAST(idx_in_trip AS BIGINT) AS idx_in_trip, n_stops_in_trip, CAST(n_stops_in_trip - idx_in_trip AS BIGINT) AS stops_left_in_trip, run_from_trip_start_s,
 round({_PLANAR.format(a="l.", b="s.stop_")}, 3) AS dist_to_target_m, round({_PLANAR.format(a="l.", b="s.stop_")} / greatest(target_s - p.t, 1), 6) AS req_speed_mps, stop_lat, stop_lon,
 est_dev_last, est_dev_slope, round(est_dev_mean3, 6) AS est_dev_mean3, round(est_dev_std5, 6) AS est_dev_std5, time_since_match_s, n_matched_30m, n_matched_60m,
 CAST(hour(make_timestamp(p.t * 1000000)) AS INT) AS hour, CAST(minute(make_timestamp(p.t * 1000000)) AS INT) AS minute, CAST(isodow(make_timestamp(p.t * 1000000)) - 1 AS INT) AS dow,
 CAST(hour(make_timestamp(target_s * 1000000)) AS INT) AS targ_hour, CAST(minute(make_timestamp(target_s * 1000000)) AS INT) AS targ_minute,
 round(cur_dev_s * (target_s - p.t) / 900.0::DOUBLE, 6) AS cur_x_horizon, round(cur_dev_s / greatest(target_s - p.t, 1), 9) AS cur_over_horizon, s.stop_key, prior_n, prior_sum, prior_median, round(CAST(prior_sum AS DOUBLE) / prior_n, 6) AS prior_mean,
 CASE WHEN prior_n IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS prior_known
 FROM points p JOIN target g ON g.sample_id = p.sample_id JOIN trips s ON s.tt_action_item_id = g.target_stop_id JOIN origins o ON o.tr_id = p.tr_id JOIN windows w ON w.sample_id = p.sample_id
 JOIN deviation d ON d.sample_id = p.sample_id JOIN rates r ON r.sample_id = p.sample_id JOIN lastfix l ON l.sample_id = p.sample_id LEFT JOIN priors q ON q.stop_key = s.stop_key"""


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s, p = _base(spark, sf_dir)
    return features.full_table(p, f, s, priors.build_priors(s, P), P)


@query(_sql(_FULL, LAT0, TARGET, TRIPS, PRIORS, PAIRS, DEVIATION, STEPS, WINDOWS, LAST_FIX, RATE))
def features_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _full(spark, sf_dir)
    long = {c: F.col(c).cast("long") for c in ("stops_before_target", "idx_in_trip", "stops_left_in_trip")}
    three = [*_PATH, "dist_to_target_m"]
    six = [c for c in _SPEED if "npts" not in c] + [f"avg_v_{n}" for n in P.window_names] + ["valid_rate_all", "req_speed_mps", "est_dev_mean3", "est_dev_std5", "cur_x_horizon", "prior_mean"]
    return _rounded(_rounded(_rounded(df.withColumns(long), 3, *three), 6, *six), 9, "cur_over_horizon")


_JUMPS = f"""
glitched AS (SELECT event_id, f.tr_id, ts, lat + CASE WHEN event_id % 97 = 0 THEN 0.9::DOUBLE ELSE 0 END AS lat, lon FROM traffic f WHERE location_valid),
jo AS (SELECT tr_id, median(lat) AS lat0, median(lon) AS lon0 FROM glitched GROUP BY 1),
j1 AS (SELECT g.*, lat0, lon0, count(*) OVER (PARTITION BY g.tr_id) AS n, row_number() OVER w AS rn, lag(ts) OVER w AS p_ts, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM glitched g JOIN jo ON jo.tr_id = g.tr_id WINDOW w AS (PARTITION BY g.tr_id ORDER BY ts, event_id)),
j2 AS (SELECT *, coalesce({_PLANAR.format(a="", b="p_")} > greatest({P.jump_min}, {P.jump_speed}::DOUBLE * abs(ts - p_ts)), false) AS fp FROM j1),
j3 AS (SELECT *, coalesce(lead(fp) OVER (PARTITION BY tr_id ORDER BY ts, event_id), false) AS fn FROM j2),
j4 AS (SELECT *, NOT (fp AND fn) AS k FROM j3),
j5 AS (SELECT *, coalesce(lead(k) OVER w, false) AS kn, coalesce(lag(k) OVER w, false) AS kp FROM j4 WINDOW w AS (PARTITION BY tr_id ORDER BY ts, event_id))"""


@query(_sql(f"SELECT event_id, tr_id, ts FROM j5 WHERE n < 3 OR (k AND NOT (rn = 1 AND fn AND kn) AND NOT (rn = n AND fp AND kp) AND sqrt(pow((lat - lat0) * 111132.0::DOUBLE, 2) + pow((lon - lon0) * 111320.0::DOUBLE * cos(radians(lat0)), 2)) <= {P.center_max})", _JUMPS))
def gps_jump_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = matching.valid_fixes(fixtures.traffic(spark, sf_dir)).withColumn("lat", F.col("lat") + F.when(F.col("event_id") % 97 == 0, 0.9).otherwise(0.0))
    return clean.drop_jumps(f, clean.track_origin(f), P).select("event_id", "tr_id", "ts")


@query(_sql("SELECT unit_id, arg_max(tr_id, n * 10000000 - tr_id) AS tr_id FROM (SELECT tr_id % 20 AS unit_id, tr_id, count(*) AS n FROM traffic GROUP BY 1, 2) GROUP BY 1"))
def unit_mode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.unit_map(fixtures.traffic(spark, sf_dir).withColumn("unit_id", F.col("tr_id") % 20))


@query(_sql("SELECT event_id, coalesce(m.tr_id, f.unit_id) AS tr_id, f.ts + 264 * 86400 - 86400 * CAST(round_even((f.ts + 264 * 86400 - 1705363200) / 86400.0::DOUBLE, 0) AS BIGINT) AS ts FROM traffic f LEFT JOIN (SELECT DISTINCT unit_id, tr_id FROM traffic WHERE tr_id % 3 <> 0) m ON m.unit_id = f.unit_id"))
def align_stream_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.traffic(spark, sf_dir)
    units = clean.unit_map(f.where("tr_id % 3 <> 0"))
    return clean.bind(f.withColumn("ts", F.col("ts") + 264 * 86400), units, 1705363200).select("event_id", "tr_id", "ts")


@query(_sql("SELECT event_id, CAST(hour(make_timestamp(ts * 1000000)) AS INT) AS hour, CAST(minute(make_timestamp(ts * 1000000)) AS INT) AS minute, CAST(isodow(make_timestamp(ts * 1000000)) - 1 AS INT) AS dow, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso FROM traffic"))
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.traffic(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in scalars.calendar(F.col("ts")).items()), scalars.iso_time(F.col("ts")).alias("iso"))


@query(_sql(f"SELECT tr_id, max(ts) AS last_seen FROM traffic GROUP BY 1 HAVING (SELECT max(ts) FROM traffic) - max(ts) <= {P.active}"))
def active_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.traffic(spark, sf_dir)
    return app.active_vehicles(f, f.agg(F.max("ts")).first()[0], P)


_BOARD = f"""
base AS (SELECT p.*, g.target_stop_id, g.target_s, s.stop_lat, s.stop_lon, n_stops_in_trip - idx_in_trip AS stops_left_in_trip, est_dev_last, l.speed AS speed_last, CAST(p.t - fix_ts AS DOUBLE) AS age_last_s,
   coalesce(est_dev_last, 0) * 0.01::DOUBLE + coalesce(CAST(prior_sum AS DOUBLE) / prior_n, 0) AS score, row_number() OVER (PARTITION BY p.tr_id ORDER BY p.t DESC, p.sample_id DESC) AS r
  FROM points p JOIN target g ON g.sample_id = p.sample_id JOIN trips s ON s.tt_action_item_id = g.target_stop_id JOIN deviation d ON d.sample_id = p.sample_id JOIN lastfix l ON l.sample_id = p.sample_id LEFT JOIN priors q ON q.stop_key = s.stop_key),
board AS (SELECT tr_id, target_stop_id, t AS now_s, strftime(make_timestamp(target_s * 1000000), '%Y-%m-%dT%H:%M:%S') AS target_time, target_s - t AS horizon_s, CAST(round_even(least(greatest(score, -420), 700), 1) AS DOUBLE) AS pred_s, est_dev_last, speed_last, age_last_s, stop_lat, stop_lon, CAST(stops_left_in_trip AS BIGINT) AS stops_left_in_trip FROM base WHERE r = 1),
ranked_board AS (SELECT *, CAST(row_number() OVER (ORDER BY pred_s DESC NULLS LAST, tr_id) AS INT) AS rank FROM board)"""
_ALL = (LAT0, TARGET, TRIPS, PRIORS, PAIRS, DEVIATION, LAST_FIX, _BOARD)


def _score() -> Column:
    return F.coalesce("est_dev_last", F.lit(0.0)) * 0.01 + F.coalesce("prior_mean", F.lit(0.0))


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s, p = _base(spark, sf_dir)
    # Only a vehicle's latest point with a target is on the board, so only that one needs its features.
    last = matching.target_stop(p, s, P).groupBy("tr_id").agg(F.max(F.struct("t", "sample_id")).alias("x")).select(F.col("x.sample_id").alias("last_id"))
    latest = p.join(last, F.col("sample_id") == F.col("last_id"), "left_semi")
    df = features.full_table(latest, f, s, priors.build_priors(s, P), P).withColumns({"tr_id": F.col("tr_id").cast("long"), "target_stop_id": F.col("target_stop_id").cast("long"), "stops_left_in_trip": F.col("stops_left_in_trip").cast("long")})
    return app.snapshot(df, _score(), P)


@query(_sql("SELECT * FROM ranked_board", *_ALL))
def snapshot_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir).drop("sched_headway_s")


@query(_sql("SELECT rank, tr_id, target_stop_id, pred_s, CASE WHEN coalesce(speed_last, 0) < 5 THEN 'standing' WHEN coalesce(est_dev_last, 0) > 60 THEN 'accumulated_delay' ELSE 'slow_segment' END AS cause, CASE WHEN coalesce(speed_last, 0) < 5 THEN 'check_blockage' WHEN coalesce(est_dev_last, 0) > 60 THEN 'shorten_dwell' ELSE 'adjust_interval' END AS recommendation FROM ranked_board WHERE pred_s >= 120", *_ALL))
def alerts_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return app.alerts(_board(spark, sf_dir), P)


_WHATIF = """
scenario AS (SELECT tr_id, pred_s, 600.0::DOUBLE AS headway_s, least(greatest(round_even(horizon_s / 600.0::DOUBLE, 0), 1), greatest(coalesce(nullif(stops_left_in_trip, 0), 1), 1))::DOUBLE AS n_ahead, 6.0::DOUBLE AS fleet_n FROM ranked_board WHERE pred_s IS NOT NULL),
saved AS (SELECT *, 20.0::DOUBLE * n_ahead AS saved_dwell, (1 - 6.0::DOUBLE / (6.0::DOUBLE + 2)) * 0.35::DOUBLE * greatest(pred_s, 0) AS saved_bunching FROM scenario),
whatif AS (SELECT *, least(greatest(pred_s - saved_dwell - saved_bunching, -600), 700) AS whatif_s FROM saved)"""


@query(_sql("SELECT tr_id, pred_s, headway_s, n_ahead, fleet_n, saved_dwell, round(saved_bunching, 6) AS saved_bunching, round(whatif_s, 6) AS whatif_s FROM whatif", *_ALL, _WHATIF))
def whatif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(app.what_if(_board(spark, sf_dir), 2, 20.0, P), 6, "saved_bunching", "whatif_s")


@query(_sql("SELECT count(*) AS vehicles, CAST(round_even(avg(pred_s), 1) AS DOUBLE) AS mean_before_s, CAST(round_even(avg(whatif_s), 1) AS DOUBLE) AS mean_after_s, CAST(round_even(avg(pred_s) - avg(whatif_s), 1) AS DOUBLE) AS saved_s, 600.0::DOUBLE AS headway_before_s, 450.0::DOUBLE AS headway_after_s FROM whatif", *_ALL, _WHATIF))
def whatif_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return app.what_if_summary(app.what_if(_board(spark, sf_dir), 2, 20.0, P), 2)


@query(_sql("SELECT tr_id, CAST(count(*) AS INT) AS n_stops, string_agg(format('{:.6f} {:.6f}', stop_lon, stop_lat), ',' ORDER BY plan_s, tt_action_item_id) AS line FROM schedule GROUP BY 1 HAVING count(*) >= 2"))
def routes_linestring(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = app.routes(fixtures.schedule(spark, sf_dir))
    return r.select("tr_id", "n_stops", F.array_join(F.transform("line", lambda c: F.format_string("%.6f %.6f", c[0], c[1])), ",").alias("line"))


@query(_sql("SELECT count(*) AS labels, count(*) FILTER (sample_id % 5 = 0) AS no_prediction, count(*) FILTER (sample_id % 5 <> 0 AND sample_id % 11 = 0) AS other_stop, count(*) FILTER (sample_id % 5 <> 0 AND sample_id % 11 <> 0) AS scored, round(avg(abs(dev_s - 30)) FILTER (sample_id % 5 <> 0 AND sample_id % 11 <> 0), 6) AS mae_pred, round(avg(abs(dev_s)) FILTER (sample_id % 5 <> 0 AND sample_id % 11 <> 0), 6) AS mae_zero, round(avg(abs(dev_s - cur_dev_s)) FILTER (sample_id % 5 <> 0 AND sample_id % 11 <> 0), 6) AS mae_current FROM target g JOIN points p USING (sample_id) JOIN schedule s ON s.tt_action_item_id = g.target_stop_id", TARGET))
def eval_mae_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, p = _base(spark, sf_dir)
    t = matching.target_stop(p, s, P).join(p.select("sample_id", "cur_dev_s"), "sample_id").join(s.select(F.col("tt_action_item_id").alias("target_stop_id"), F.col("dev_s").alias("target_delay_s")), "target_stop_id")
    said = t.where("sample_id % 5 <> 0").select("sample_id", F.when(F.col("sample_id") % 11 == 0, -1).otherwise(F.col("target_stop_id")).alias("target_stop_id"), F.lit(30.0).alias("pred_s"))
    return _rounded(app.evaluation(said, t.select("sample_id", "target_stop_id", "cur_dev_s", "target_delay_s"), ("sample_id",)), 6, "mae_pred", "mae_zero", "mae_current")


@query(_sql("SELECT round(corr(cur_dev_s, dev_s), 9) AS r, count(*) AS n FROM target g JOIN points p USING (sample_id) JOIN schedule s ON s.tt_action_item_id = g.target_stop_id", TARGET))
def eval_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, p = _base(spark, sf_dir)
    t = matching.target_stop(p, s, P).join(p.select("sample_id", "cur_dev_s"), "sample_id").join(s.select(F.col("tt_action_item_id").alias("target_stop_id"), "dev_s"), "target_stop_id")
    return t.agg(F.round(F.corr("cur_dev_s", "dev_s"), 9).alias("r"), F.count("*").alias("n"))


_TE = "te AS (SELECT tr_id, count(*) AS n, CAST(sum(dev_s) AS DOUBLE) AS s FROM schedule GROUP BY 1), tm AS (SELECT CAST(sum(dev_s) AS DOUBLE) / count(*) AS m FROM schedule)"


@query(_sql("SELECT tt_action_item_id, round((s + 20 * m) / (n + 20), 6) AS te_tr_id FROM schedule JOIN te USING (tr_id), tm", _TE))
def target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(priors.target_encode(fixtures.schedule(spark, sf_dir), "tr_id", "dev_s").select("tt_action_item_id", "te_tr_id"), 6, "te_tr_id")


@query(_sql("SELECT tt_action_item_id, round((s - dev_s + 20 * m) / (n - 1 + 20), 6) AS te_tr_id FROM schedule JOIN te USING (tr_id), tm", _TE))
def target_encode_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(priors.target_encode(fixtures.schedule(spark, sf_dir), "tr_id", "dev_s", leave_one_out=True).select("tt_action_item_id", "te_tr_id"), 6, "te_tr_id")


@query(_sql("SELECT tt_action_item_id, round((coalesce(sum(dev_s) OVER w, 0) + 20 * m) / (count(dev_s) OVER w + 20), 9) AS ot_tr_id FROM schedule, tm WINDOW w AS (PARTITION BY tr_id ORDER BY md5(CAST(tt_action_item_id AS VARCHAR)), tt_action_item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", _TE))
def target_encode_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(priors.ordered_encode(fixtures.schedule(spark, sf_dir), "tr_id", "dev_s", "tt_action_item_id").select("tt_action_item_id", "ot_tr_id"), 9, "ot_tr_id")


@query(_sql("SELECT i / 20.0::DOUBLE AS w, round(avg(abs(dev_s - (40.0::DOUBLE * (i / 20.0::DOUBLE) + (tt_action_item_id % 200) * (1 - i / 20.0::DOUBLE)))), 6) AS mae FROM schedule, range(21) r(i) GROUP BY i"))
def blend_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.schedule(spark, sf_dir).select(F.col("dev_s").alias("y"), F.lit(40.0).alias("a"), (F.col("tt_action_item_id") % 200).alias("b"))
    return _rounded(app.blend(rows), 6, "mae")


@query(_sql("SELECT tr_id, count(*) AS n_all, count(DISTINCT stop_key) AS n_stops FROM (SELECT tr_id, stop_key FROM schedule WHERE plan_s % 2 = 0 UNION ALL SELECT tr_id, stop_key FROM schedule WHERE plan_s % 3 = 0) GROUP BY 1"))
def union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.schedule(spark, sf_dir).select("tr_id", "stop_key", "plan_s")
    both = s.where("plan_s % 2 = 0").unionByName(s.where("plan_s % 3 = 0"))
    distinct = both.dropDuplicates(["tr_id", "stop_key"]).groupBy("tr_id").agg(F.count("*").alias("n_stops"))
    return both.groupBy("tr_id").agg(F.count("*").alias("n_all")).join(distinct, "tr_id")


@query(_sql("SELECT event_id, ts FROM traffic WHERE ts >= (SELECT min(ts) FROM traffic) + 86400 AND ts <= (SELECT min(ts) FROM traffic) + 86400 + 7 * 86400"))
def replay_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.traffic(spark, sf_dir)
    first = f.agg(F.min("ts")).first()[0]
    return f.where(F.col("ts").between(first + 86400, first + 8 * 86400)).select("event_id", "ts")


@query(_sql("SELECT p.sample_id, CAST(least(greatest(count(f.ts) - 1, 0), 39) AS INT) AS n_steps, round(CASE WHEN count(f.ts) > 1 THEN (max(f.ts) - max(f.ts) FILTER (r = 2)) / 60.0::DOUBLE ELSE 0 END, 6) AS last_dt FROM points p LEFT JOIN (SELECT p.sample_id, f.ts, row_number() OVER (PARTITION BY p.sample_id ORDER BY f.ts DESC) AS r FROM points p JOIN traffic f ON f.tr_id = p.tr_id AND f.location_valid AND f.ts <= p.t) f ON f.sample_id = p.sample_id GROUP BY 1"))
def sequence_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _, p = _base(spark, sf_dir)
    s = features.last_sequences(p, f)
    return s.select("sample_id", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_steps"), F.round(F.get(F.get("seq", F.lit(38)), F.lit(0)), 6).alias("last_dt"))


_SLOW = """
r0 AS (SELECT tr_id, ts, speed_c < 25000 AS low, row_number() OVER (PARTITION BY tr_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY tr_id, speed_c < 25000 ORDER BY ts, event_id) AS island FROM traffic WHERE location_valid),
r1 AS (SELECT tr_id, island, min(ts) AS since, max(ts) - min(ts) AS seconds, count(*) AS n FROM r0 WHERE low GROUP BY 1, 2)"""


@query(_sql("SELECT tr_id, since, seconds, n FROM (SELECT *, row_number() OVER (PARTITION BY tr_id ORDER BY seconds DESC, since) AS r FROM r1) WHERE r = 1", _SLOW))
def gaps_islands_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = matching.valid_fixes(fixtures.traffic(spark, sf_dir)).withColumn("low", F.col("speed_c") < 25000)
    order = Window.partitionBy("tr_id").orderBy("ts", "event_id")
    runs = f.withColumn("run", F.sum((~F.col("low")).cast("int")).over(order)).where("low").groupBy("tr_id", "run").agg(F.min("ts").alias("since"), (F.max("ts") - F.min("ts")).alias("seconds"), F.count("*").alias("n"))
    return runs.groupBy("tr_id").agg(F.max(F.struct("seconds", (-F.col("since")).alias("m"), "n")).alias("x")).select("tr_id", (-F.col("x.m")).alias("since"), "x.seconds", "x.n")


@query(_sql(f"SELECT tr_id, ts, lat, lon, round(d, 3) AS dist_m FROM (SELECT f.tr_id, f.ts, f.lat, f.lon, min({_PLANAR.format(a='f.', b='s.stop_')}) AS d, row_number() OVER (PARTITION BY f.tr_id ORDER BY f.ts DESC, f.lat DESC, f.lon DESC) AS r FROM (SELECT tr_id, ts, min(lat) AS lat, arg_min(lon, lat) AS lon FROM traffic WHERE location_valid GROUP BY 1, 2) f JOIN origins o ON o.tr_id = f.tr_id JOIN schedule s ON s.tr_id = f.tr_id GROUP BY 1, 2, 3, 4 HAVING min({_PLANAR.format(a='f.', b='s.stop_')}) <= {P.corridor}) WHERE r = 1", LAT0))
def marker_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s, _ = _base(spark, sf_dir)
    return _rounded(matching.marker_position(f, s, P), 3, "dist_m")


@query(_sql("SELECT event_id, round(2 * 6371000.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians(lat - 55.75::DOUBLE) / 2), 2) + cos(radians(55.75::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - 37.6::DOUBLE) / 2), 2)))), 3) AS haversine_m, CASE WHEN speed >= 300 THEN 'critical' WHEN speed >= 120 THEN 'high' WHEN speed >= 30 THEN 'moderate' ELSE 'normal' END AS risk FROM traffic"))
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.traffic(spark, sf_dir)
    d = geo.haversine_m(F.lit(55.75), F.lit(37.6), F.col("lat"), F.col("lon"))
    return f.select("event_id", F.round(d, 3).alias("haversine_m"), scalars.risk(F.col("speed") / 60).alias("risk"))


_KEPT = f"""WITH RECURSIVE {fixtures.SQL},
f AS (SELECT tr_id, ts, lat, lon, row_number() OVER (PARTITION BY tr_id, ts ORDER BY lat, lon) AS first, row_number() OVER (PARTITION BY tr_id ORDER BY ts DESC, lat DESC, lon DESC) AS back FROM traffic WHERE location_valid),
k AS (SELECT tr_id, min(ts) AS ts, 0 AS i FROM f GROUP BY 1 UNION ALL SELECT k.tr_id, min(f.ts), max(k.i) + 1 FROM k JOIN f ON f.tr_id = k.tr_id AND f.ts >= k.ts + 36000 GROUP BY 1),
c AS (SELECT f.*, k.i FROM f LEFT JOIN k ON k.tr_id = f.tr_id AND k.ts = f.ts AND f.first = 1),
n AS (SELECT tr_id, count(*) FILTER (i IS NOT NULL AND back > 1) AS n FROM c GROUP BY 1),
s AS (SELECT tr_id, n, CAST(greatest(1, ceil((n + 1) / 30.0)) AS BIGINT) AS step FROM n)
SELECT c.tr_id, ts, lat, lon FROM c JOIN s ON s.tr_id = c.tr_id WHERE back = 1 OR (i % step = 0 AND NOT (n % step <> 0 AND i = n // step * step))"""


@query(_KEPT)
def decimate_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = matching.valid_fixes(fixtures.traffic(spark, sf_dir)).select("tr_id", "ts", "lat", "lon")
    return track.decimate(f, apart=36_000.0, most=30)
