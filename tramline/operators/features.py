"""Point-in-time features: windows over the track, deviations of matched stops, and the full table.

Nothing later than a point's time is visible to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import local_xy, planar_m
from tramline.functions.scalars import calendar
from tramline.operators.matching import BUCKET, FIX, before_bucket, keyed, match_pairs, target_stop, valid_fixes, with_origin
from tramline.operators.priors import attach_priors
from tramline.operators.scan import saved
from tramline.operators.track import passages
from tramline.operators.trips import with_trips
from tramline.profile import Profile


def window_features(points: DataFrame, traffic: DataFrame, origin: DataFrame, p: Profile) -> DataFrame:
    """Speeds, path and displacement over (t - w, t] for each window w, the last fix and the valid rate so far.

    origin has tr_id, lat0 and lon0.  Track and points are dealt to a vehicle's
    buckets of the longest window's length, a fix also to the next one, so that
    each point's windows lie within its bucket's rows and a busy vehicle is spread
    over many tasks.  What goes further back, the last fix and the rate, is
    carried from bucket to bucket.  A path within a window is a difference of
    running path lengths.
    """
    width = max(p.windows)
    bucket = lambda c: F.floor(F.col(c) / width)
    null = lambda t: F.lit(None).cast(t)
    good = F.coalesce("location_valid", F.lit(False)) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    y, x = local_xy(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    speed = F.coalesce("speed", F.lit(0.0))
    seen = traffic.select(
        "tr_id", F.col("ts").alias("k"), bucket("ts").alias("bucket"), good.cast("int").alias("ok"), "lat", "lon", speed.alias("speed"),
        F.when(good, F.struct("ts", "lat", "lon", speed.alias("speed"))).alias("fix"),
    )
    fixes = seen.where("ok = 1").join(origin, "tr_id", "left").withColumns({"y": y, "x": x, "own": F.col("bucket")})
    fixes = fixes.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    order = Window.partitionBy("tr_id", "bucket").orderBy("k", "lat", "lon")
    step = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order))
    fixes = fixes.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("path", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    track = fixes.select("tr_id", "bucket", "k", F.lit(0).alias("kind"), null("long").alias("sample_id"), "speed", "x", "y", "path", "fix", F.when(F.col("bucket") == F.col("own"), 1).alias("ok"))
    nothing = [null("double").alias(c) for c in ("speed", "x", "y", "path")]
    bad = seen.where("ok = 0").select("tr_id", "bucket", "k", F.lit(0).alias("kind"), null("long").alias("sample_id"), *nothing, "fix", "ok")
    asked = points.select("tr_id", bucket("t").alias("bucket"), F.col("t").alias("k"), F.lit(1).alias("kind"), "sample_id", *nothing, null(FIX).alias("fix"), null("int").alias("ok"))
    both = keyed(track.unionByName(bad).unionByName(asked))
    by_time = Window.partitionBy(*BUCKET).orderBy("k")
    so_far = by_time.rangeBetween(Window.unboundedPreceding, 0)
    last = F.last("fix", ignorenulls=True).over(Window.partitionBy(*BUCKET).orderBy("k", "kind", "fix.lat", "fix.lon").rowsBetween(Window.unboundedPreceding, 0))
    cols: dict[str, Column] = {"fix": last, "n_here": F.count("ok").over(so_far), "ok_here": F.coalesce(F.sum("ok").over(so_far), F.lit(0))}
    for w, name in zip(p.windows, p.window_names, strict=True):
        f = by_time.rangeBetween(-(w - 1), 0)
        n = F.count("speed").over(f)
        cols |= {
            f"speed_mean_{name}": F.avg("speed").over(f),
            f"speed_std_{name}": F.when(n > 1, F.stddev_pop("speed").over(f)),
            f"speed_max_{name}": F.max("speed").over(f),
            f"npts_{name}": n,
            f"idle_frac_{name}": F.avg((F.col("speed") < p.idle_speed).cast("int")).over(f),
            f"travel_m_{name}": F.when(n > 1, F.max("path").over(f) - F.min("path").over(f)),
            f"_a_{name}": F.min_by(F.struct("x", "y"), "path").over(f),
            f"_b_{name}": F.max_by(F.struct("x", "y"), "path").over(f),
        }
    own = F.when(F.col("ok") == 1, F.col("fix"))  # a fix in its own bucket, not its copy in the next
    before = before_bucket(both, own, {"n": F.count("ok"), "ok": F.coalesce(F.sum("ok"), F.lit(0))})
    out = both.withColumns(cols).where("kind = 1").join(before, list(BUCKET))
    rate = (F.col("before_ok") + F.col("ok_here")) / F.nullif(F.col("before_n") + F.col("n_here"), F.lit(0))
    out = out.withColumns({"fix": F.coalesce("fix", "before_fix"), "valid_rate_all": rate})
    more = {}
    for w, name in zip(p.windows, p.window_names, strict=True):
        a, b = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        more[f"disp_m_{name}"] = F.when(F.col(f"npts_{name}") > 1, F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
        more[f"avg_v_{name}"] = F.col(f"travel_m_{name}") / w
    out = out.withColumns(more | {"age_last_s": (F.col("k") - F.col("fix.ts")).cast("double"), "speed_last": F.col("fix.speed")})
    inner = ("n_here", "ok_here", "before_fix", "before_n", "before_ok")
    return out.drop("kind", "speed", "x", "y", "path", "ok", "k", *BUCKET, *inner, *(f"_{e}_{n}" for e in "ab" for n in p.window_names))


def match_versions(traffic: DataFrame, schedule: DataFrame, p: Profile, steps: DataFrame | None = None) -> DataFrame:
    """What is known of each matched stop's delay, and from when until when (exclusive, null for good).

    A stop's best fix changes while its window is open; each improvement is a
    version, so that a point reads exactly one per stop.  With steps, the segments
    of matched tracks (lattice.segments), a passage along the track counts before
    any fix nearby; it is known from the step's end.
    """
    pairs = match_pairs(traffic, schedule, p).distinct().withColumn("by", F.lit(1))
    if steps is not None:
        passed = passages(steps, schedule, p.match_radius, float(p.match_window))
        passed = passed.where(F.col("n_ts") <= F.col("plan_s") + p.match_window)
        pairs = pairs.withColumn("dt", F.col("dt").cast("double")).unionByName(
            passed.select("tr_id", "tt_action_item_id", "plan_s", F.col("n_ts").cast("long").alias("ts"), F.col("delay").alias("dt"), F.lit(0).alias("by"))
        )
    order = Window.partitionBy("tt_action_item_id").orderBy("ts", "by", F.abs("dt"), "dt")
    best = F.min(F.struct("by", F.abs("dt").alias("a"), "ts", "dt")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    better = pairs.withColumn("best", best).where((F.col("best.ts") == F.col("ts")) & (F.col("best.by") == F.col("by")) & (F.col("best.dt") == F.col("dt")))
    known = F.greatest(F.col("ts"), F.col("plan_s") + p.plan_lead)
    out = better.withColumns({"since": known, "until": F.lead(known).over(order)})
    return out.where(F.col("until").isNull() | (F.col("since") < F.col("until"))).select("tr_id", "tt_action_item_id", "plan_s", F.col("dt").alias("delay"), "since", "until")


def _last(stops: Column, n: int = 5) -> Column:
    """The n last of an ordered array."""
    return F.slice(stops, F.greatest(F.size(stops) - n + 1, F.lit(1)), F.lit(n))


def _settled(asked: DataFrame, final: DataFrame, width: int, short: int) -> DataFrame:
    """For each asked (sample_id, tag, tr_id, k) the stops planned up to k: n, n_short and the five last of them, in order.

    final has a row per matched stop.  Both are dealt to a vehicle's buckets of
    `width` seconds; counts and the five last stops are carried from bucket to
    bucket, so what a point is joined with does not grow with the history.
    """
    bucket = F.floor(F.col("k") / width)
    stop = F.struct(F.col("plan_s").alias("plan"), F.col("tt_action_item_id").alias("id"), F.col("delay").alias("d"))
    rows = final.select("tr_id", F.col("plan_s").alias("k"), stop.alias("stop"), (F.abs("delay") <= short).cast("long").alias("close")).withColumn("bucket", bucket)
    own = Window.partitionBy("tr_id", "bucket").orderBy("k", "stop.id")
    rows = rows.withColumns({"five": F.collect_list("stop").over(own.rowsBetween(-4, 0)), "id": F.col("stop.id"), "kind": F.lit(0)})
    kind = rows.schema["five"].dataType
    asks = asked.withColumns({"bucket": bucket, "five": F.lit(None).cast(kind), "close": F.lit(None).cast("long"), "kind": F.lit(1), "id": F.lit(0).cast("long")})
    names = ["tr_id", "bucket", "k", "kind", "id", "five", "close", "sample_id", "tag"]
    both = rows.withColumns({"sample_id": F.lit(None).cast("long"), "tag": F.lit(None).cast("string")}).select(*names).unionByName(asks.select(*names))
    past = Window.partitionBy("tr_id", "bucket").orderBy("k", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumns({"n": F.count("close").over(past), "n_close": F.coalesce(F.sum("close").over(past), F.lit(0)), "five": F.last("five", ignorenulls=True).over(past)}).where("kind = 1")
    some = both.groupBy("tr_id", "bucket").agg(F.count("close").alias("n"), F.coalesce(F.sum("close"), F.lit(0)).alias("n_close"), F.max_by("five", F.when(F.col("five").isNotNull(), F.struct("k", "id"))).alias("five"))
    over = Window.partitionBy("tr_id").orderBy("bucket")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    # Of the buckets before, the last five that have stops are enough.
    some = some.withColumn("filled", F.coalesce(F.sum((F.col("n") > 0).cast("long")).over(earlier), F.lit(0)))
    full = some.where("n > 0").select("tr_id", F.col("filled").alias("number"), "bucket", "five")
    by_five = Window.partitionBy("tr_id").orderBy("number")
    full = full.withColumn("so_far", _last(F.flatten(F.collect_list("five").over(by_five.rowsBetween(-4, 0)))))
    before = some.select(
        F.col("tr_id").alias("b_tr"), F.col("bucket").alias("b_bucket"), "filled",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("b_n"), F.coalesce(F.sum("n_close").over(earlier), F.lit(0)).alias("b_close"),
    )
    before = before.join(full.select(F.col("tr_id").alias("f_tr"), (F.col("number") + 1).alias("f_number"), "so_far"), F.col("b_tr").eqNullSafe(F.col("f_tr")) & (F.col("filled") == F.col("f_number")), "left")
    found = here.join(before, F.col("tr_id").eqNullSafe(F.col("b_tr")) & (F.col("bucket") == F.col("b_bucket")))
    none = F.array().cast(kind)
    return found.select(
        "sample_id", "tag", (F.col("n") + F.col("b_n")).alias("n"), (F.col("n_close") + F.col("b_close")).alias("n_close"),
        _last(F.concat(F.coalesce("so_far", none), F.coalesce("five", none))).alias("five"),
    )


def deviation_features(points: DataFrame, traffic: DataFrame, schedule: DataFrame, p: Profile, steps: DataFrame | None = None) -> DataFrame:
    """est_dev_*, n_matched_* and time_since_match_s of each point, from stops matched by fixes up to t.

    A stop's delay can change only until match_window seconds after its plan.  Of
    such open stops a point is joined with those planned in that time before it;
    of all that is settled it reads counts and the five last stops.  With steps,
    passages along matched tracks refine the delays.
    """
    v = match_versions(traffic, schedule, p, steps)
    if steps is not None:
        v = saved(v)  # a row per version of a stop; tracks are matched once, not for each of its uses
    wait = max(p.match_window, p.plan_lead)
    keys = {"settled": F.col("t") - wait}
    if p.counting != "online":
        keys |= {"short": F.least(F.col("t") - p.matched_short - 1, F.col("t") - wait), "long": F.least(F.col("t") - p.matched_long - 1, F.col("t") - wait)}
    asked = points.select("sample_id", "tr_id", F.explode(F.array(*(F.struct(F.lit(n).alias("tag"), k.cast("long").alias("k")) for n, k in keys.items()))).alias("x")).select("sample_id", "tr_id", "x.*")
    known = _settled(asked, v.where("until IS NULL"), 2 * wait, p.matched_short)
    of = lambda tag, c: F.max(F.when(F.col("tag") == tag, F.col(c)))
    known = known.groupBy("sample_id").agg(*(of(n, "n").alias(f"n_{n}") for n in keys), of("settled", "n_close").alias("n_close"), F.max_by("five", F.col("tag") == "settled").alias("five"))

    dealt = points.select("sample_id", "tr_id", "t", F.explode(F.sequence(F.floor((F.col("t") - wait + 1) / wait), F.floor(F.col("t") / wait))).alias("b"))
    open_ = v.withColumns({"b": F.floor(F.col("plan_s") / wait)}).withColumnRenamed("tr_id", "v_tr").withColumnRenamed("b", "v_b")
    inside = (F.col("plan_s") > F.col("t") - wait) & (F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    seen = dealt.join(open_, (F.col("tr_id") == F.col("v_tr")) & (F.col("b") == F.col("v_b")) & inside)
    delay, plan = F.col("delay"), F.col("plan_s")
    short, long_ = (
        (F.count_if(F.abs(delay) <= p.matched_short), F.count("*")) if p.counting == "online"
        else (F.count_if(plan >= F.col("t") - p.matched_short), F.count_if(plan >= F.col("t") - p.matched_long))
    )
    fresh = seen.groupBy("sample_id").agg(short.alias("o_short"), long_.alias("o_long"), F.array_sort(F.collect_list(F.struct(plan.alias("plan"), F.col("tt_action_item_id").alias("id"), delay.alias("d")))).alias("o_stops"))
    got = points.select("sample_id", "t").join(known, "sample_id", "left").join(fresh, "sample_id", "left")
    nothing = F.array().cast(known.schema["five"].dataType)
    # All open stops are planned later than all settled ones.
    last = _last(F.concat(F.coalesce("five", nothing), F.coalesce("o_stops", nothing)))
    if p.counting == "online":
        settled_short, settled_long = F.col("n_close"), F.col("n_settled")
    else:
        settled_short, settled_long = F.col("n_settled") - F.col("n_short"), F.col("n_settled") - F.col("n_long")
    zero = F.lit(0).cast("long")
    got = got.select(
        "sample_id", "t", F.reverse(last).alias("r"), (F.coalesce(settled_short, zero) + F.coalesce("o_short", zero)).alias("n_matched_30m"), (F.coalesce(settled_long, zero) + F.coalesce("o_long", zero)).alias("n_matched_60m")
    )
    d = lambda i: F.get("r", F.lit(i))["d"]
    number = "double" if steps is not None else "long"
    total = lambda k, f: F.aggregate(F.slice("r", 1, k), F.lit(0).cast(number), lambda acc, x: acc + f(x["d"]))
    n5, n3 = F.least(F.size("r"), F.lit(5)), F.least(F.size("r"), F.lit(3))
    return got.select(
        "sample_id",
        d(0).cast("double").alias("est_dev_last"),
        (d(0) - d(1)).cast("double").alias("est_dev_slope"),
        F.when(n3 > 0, total(3, lambda x: x) / F.nullif(n3, F.lit(0))).alias("est_dev_mean3"),
        F.when(n5 > 1, F.sqrt(F.greatest((n5 * total(5, lambda x: x * x) - F.pow(total(5, lambda x: x), F.lit(2))).cast("double"), F.lit(0.0))) / n5).alias("est_dev_std5"),
        "n_matched_30m", "n_matched_60m",
        (F.col("t") - F.get("r", F.lit(0))["plan"]).cast("double").alias("time_since_match_s"),
    )


#: The names and order of the model's features.
FEATURES = (
    "tr_id target_stop_id cur_dev_s horizon_s age_last_s speed_last".split()
    + [f"{f}_{w}" for w in ("5m", "10m", "15m", "30m") for f in ("speed_mean", "speed_std", "speed_max", "npts", "idle_frac", "travel_m", "disp_m", "avg_v")]
    + "valid_rate_all stops_before_target planned_gap_prev_s idx_in_trip n_stops_in_trip stops_left_in_trip run_from_trip_start_s".split()
    + "dist_to_target_m req_speed_mps stop_lat stop_lon est_dev_last est_dev_slope est_dev_mean3 est_dev_std5 time_since_match_s n_matched_30m n_matched_60m".split()
    + "hour minute dow targ_hour targ_minute cur_x_horizon cur_over_horizon stop_key prior_n prior_sum prior_median prior_mean prior_known".split()
)


def full_table(points: DataFrame, traffic: DataFrame, schedule: DataFrame, priors: DataFrame, p: Profile, label: str | None = None, steps: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """sample_id, t and all 69 features of each point with a target stop, and the columns `also` of its schedule; with label, that
    column of the schedule too, and priors without the row's own; with steps, delays are refined along matched tracks."""
    target = target_stop(points, schedule, p).drop("tr_id", "t")
    stops = with_origin(with_trips(schedule, p)).drop("plan_s").withColumnRenamed("tt_action_item_id", "target_stop_id")
    keep = ["target_stop_id", "stop_lat", "stop_lon", "lat0", "stop_key", "stops_before_target", "planned_gap_prev_s", "idx_in_trip", "n_stops_in_trip", "stops_left_in_trip", "run_from_trip_start_s", *([label] if label else []), *also]
    origin = schedule.groupBy("tr_id").agg(F.median("stop_lat").alias("lat0"), F.median("stop_lon").alias("lon0"))
    # Narrow rows go by stop and place first; the many columns of the windows are dealt once, by sample_id.
    df = attach_priors(points.join(target, "sample_id").join(stops.select(*keep), "target_stop_id"), priors, label)
    df = df.join(window_features(points, traffic, origin, p), "sample_id").join(deviation_features(points, traffic, schedule, p, steps), "sample_id")
    horizon = F.col("target_s") - F.col("t")
    df = df.withColumns(
        {
            "horizon_s": horizon, "dist_to_target_m": planar_m(F.col("fix.lat"), F.col("fix.lon"), F.col("stop_lat"), F.col("stop_lon"), F.col("lat0")),
            "cur_x_horizon": F.col("cur_dev_s") * horizon / 900.0, "cur_over_horizon": F.col("cur_dev_s") / F.greatest(horizon, F.lit(1)),
        }
        | calendar(F.col("t"))
        | {k: v for k, v in calendar(F.col("target_s"), "targ_").items() if k != "targ_dow"}
    ).withColumn("req_speed_mps", F.col("dist_to_target_m") / F.greatest(horizon, F.lit(1)))
    text = {"tr_id": F.col("tr_id").cast("string"), "target_stop_id": F.col("target_stop_id").cast("string")}
    return df.withColumns(text).select("sample_id", "t", *FEATURES, *([label] if label else []), *also)


def last_sequences(points: DataFrame, traffic: DataFrame, k: int = 40) -> DataFrame:
    """For each point the last k - 1 steps as (dt/60, dx/100, dy/100, v/60, sin, cos), left-padded with zeros, and a mask."""
    fixes = valid_fixes(traffic)
    order = Window.partitionBy("tr_id").orderBy("ts", "lat", "lon")
    lag = {c: F.lag(c).over(order) for c in ("ts", "lat", "lon")}
    y, x = local_xy(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    steps = fixes.withColumns({f"p_{c}": e for c, e in lag.items()}).withColumn(
        "step",
        F.when(
            F.col("p_ts").isNotNull(),
            F.array(
                (F.col("ts") - F.col("p_ts")) / 60.0, x / 100.0, y / 100.0, F.coalesce("speed", F.lit(0.0)) / 60.0,
                F.sin(F.radians(F.coalesce("heading", F.lit(0.0)))), F.cos(F.radians(F.coalesce("heading", F.lit(0.0)))),
            ),
        ),
    )
    steps = steps.withColumn("seq", F.collect_list("step").over(order.rowsBetween(-(k - 2), 0))).select("tr_id", "ts", "lat", "lon", "seq")
    both = points.select("tr_id", F.col("t").alias("ts"), F.lit(1).alias("kind"), "sample_id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("array<array<double>>").alias("seq")).unionByName(
        steps.withColumns({"kind": F.lit(0), "sample_id": F.lit(None).cast("long")})
    )
    seq = F.last("seq", ignorenulls=True).over(Window.partitionBy("tr_id").orderBy("ts", "kind", "lat", "lon").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("seq", F.coalesce(seq, F.array().cast("array<array<double>>"))).where("kind = 1")
    gap = F.lit(k - 1) - F.size("seq")
    return out.select(
        "sample_id",
        F.concat(F.array_repeat(F.array_repeat(F.lit(0.0), 6), gap), "seq").alias("seq"),
        F.concat(F.array_repeat(F.lit(0), gap), F.array_repeat(F.lit(1), F.size("seq"))).alias("mask"),
    )
