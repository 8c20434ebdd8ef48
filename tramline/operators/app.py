"""What a dispatcher sees: the snapshot board, alerts, scenarios, routes, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.scalars import clamp, iso_time
from tramline.profile import Profile


def active_vehicles(traffic: DataFrame, now: Column | int, p: Profile) -> DataFrame:
    """Vehicles last seen at most `active` seconds before now: tr_id, last_seen."""
    now = F.lit(now) if isinstance(now, int) else now
    return traffic.groupBy("tr_id").agg(F.max("ts").alias("last_seen")).where(now - F.col("last_seen") <= p.active)


def snapshot(features: DataFrame, score: Column, p: Profile) -> DataFrame:
    """One row per vehicle from its latest point, ranked by the predicted delay, unknown ones last.

    score is a prediction in seconds; it is clipped and rounded to one decimal.
    """
    latest = features.withColumn("score", score).groupBy("tr_id").agg(F.max(F.struct("t", "sample_id", *(c for c in features.columns if c not in ("t", "sample_id", "tr_id")), "score")).alias("x")).select("tr_id", "x.*")
    pred = F.bround(clamp(F.col("score"), *p.clip), 1)
    board = latest.select(
        "tr_id", "target_stop_id", F.col("t").alias("now_s"), iso_time((F.col("t") + F.col("horizon_s")).cast("long")).alias("target_time"), "horizon_s", pred.alias("pred_s"),
        "est_dev_last", "speed_last", "age_last_s", "stop_lat", "stop_lon", "stops_left_in_trip", F.lit(None).cast("double").alias("sched_headway_s"),
    )
    # The board has a row per vehicle of a fleet; its ranks are of that size whatever the track's.
    return board.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("pred_s"), "tr_id")))


def alerts(board: DataFrame, p: Profile) -> DataFrame:
    """Late vehicles with the likely cause and what to do."""
    speed, dev = F.coalesce("speed_last", F.lit(0.0)), F.coalesce("est_dev_last", F.lit(0.0))
    cause = F.when(speed < p.idle_speed, "standing").when(dev > 60, "accumulated_delay").otherwise("slow_segment")
    advice = F.when(speed < p.idle_speed, "check_blockage").when(dev > 60, "shorten_dwell").otherwise("adjust_interval")
    late = board.where(F.col("pred_s").isNotNull() & (F.col("pred_s") >= p.alert))
    return late.select("rank", "tr_id", "target_stop_id", "pred_s", cause.alias("cause"), advice.alias("recommendation"))


def what_if(board: DataFrame, extra_vehicles: int, dwell_reduction_s: float, p: Profile) -> DataFrame:
    """Predicted delays if vehicles are added and stops made shorter: saved_dwell, saved_bunching, whatif_s."""
    headway = F.coalesce(F.nullif("sched_headway_s", F.lit(0.0)), F.lit(600.0))
    horizon = F.coalesce(F.nullif("horizon_s", F.lit(0)), F.lit(720)).cast("double")
    apart = F.greatest(headway, F.lit(60.0))
    left = F.greatest(F.coalesce(F.nullif("stops_left_in_trip", F.lit(0)), F.lit(1)), F.lit(1))
    ahead = F.least(F.greatest(F.bround(horizon / apart), F.lit(1.0)), left.cast("double"))
    fleet = F.greatest(F.lit(1.0), F.bround(F.lit(3600.0) / apart))
    more = float(max(extra_vehicles, 0))
    bunching = (1 - fleet / (fleet + more)) * p.bunching_share * F.greatest("pred_s", F.lit(0.0))
    rows = board.where(F.col("pred_s").isNotNull()).withColumns({"headway_s": headway, "n_ahead": ahead, "fleet_n": fleet})
    rows = rows.withColumns({"saved_dwell": dwell_reduction_s * F.col("n_ahead"), "saved_bunching": bunching})
    return rows.withColumn("whatif_s", clamp(F.col("pred_s") - F.col("saved_dwell") - F.col("saved_bunching"), *p.whatif_clip)).select(
        "tr_id", "pred_s", "headway_s", "n_ahead", "fleet_n", "saved_dwell", "saved_bunching", "whatif_s"
    )


def what_if_summary(rows: DataFrame, extra_vehicles: int) -> DataFrame:
    """Means of a scenario's rows, and the headway before and after."""
    more = float(max(extra_vehicles, 0))
    a = rows.agg(
        F.count("*").alias("n"), F.avg("pred_s").alias("before"), F.avg("whatif_s").alias("after"), F.avg("headway_s").alias("headway"), F.avg("fleet_n").alias("fleet")
    )
    return a.select(
        F.col("n").alias("vehicles"), F.bround("before", 1).alias("mean_before_s"), F.bround("after", 1).alias("mean_after_s"), F.bround(F.col("before") - F.col("after"), 1).alias("saved_s"),
        F.bround("headway", 0).alias("headway_before_s"), F.bround(F.col("headway") * F.col("fleet") / (F.col("fleet") + more), 0).alias("headway_after_s"),
    )


def routes(schedule: DataFrame) -> DataFrame:
    """A straight-line route per vehicle with two stops or more, as GeoJSON features."""
    stops = F.array_sort(F.collect_list(F.struct("plan_s", "tt_action_item_id", "stop_lon", "stop_lat")))
    line = F.transform("s", lambda x: F.array(F.round(x["stop_lon"], 6), F.round(x["stop_lat"], 6)))
    geo = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("tr_id").alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates")).alias("geometry")))
    return schedule.groupBy("tr_id").agg(stops.alias("s")).where(F.size("s") >= 2).withColumn("line", line).select("tr_id", F.size("s").alias("n_stops"), "line", geo.alias("feature"))


def evaluation(predictions: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("tr_id", "t")) -> DataFrame:
    """MAE of predictions and of the two baselines where predicted and labelled stop agree, and how many don't.

    predictions: keys, target_stop_id, pred_s.  labels: keys, target_stop_id, cur_dev_s, target_delay_s.  keys tell
    points apart; a vehicle with two points in one second needs their sample_id.
    """
    both = labels.withColumnRenamed("target_stop_id", "label_stop").join(predictions, list(keys), "left")
    same = F.col("target_stop_id") == F.col("label_stop")
    y = F.col("target_delay_s")
    mae = lambda e: F.avg(F.when(same, F.abs(e)))
    return both.agg(
        F.count("*").alias("labels"), F.count_if(F.col("pred_s").isNull()).alias("no_prediction"), F.count_if(~same).alias("other_stop"), F.count_if(same).alias("scored"),
        mae(y - F.col("pred_s")).alias("mae_pred"), mae(y).alias("mae_zero"), mae(y - F.col("cur_dev_s")).alias("mae_current"),
    )


def blend(predictions: DataFrame, steps: int = 20) -> DataFrame:
    """MAE of w * a + (1 - w) * b for each weight on a grid; columns y, a and b."""
    weights = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    # Absolute errors of all weights are summed in one pass over the rows.
    sums = predictions.agg(*(F.avg(F.abs(F.col("y") - (F.col("a") * (i / steps) + F.col("b") * (1 - i / steps)))).alias(f"w{i}") for i in range(steps + 1)))
    return sums.select(F.array(*(f"w{i}" for i in range(steps + 1))).alias("m"), weights.alias("i")).select((F.col("i") / steps).alias("w"), F.get("m", F.col("i")).alias("mae"))
