"""Cleaning of tracks and binding of units to vehicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.geo import planar_m
from tramline.functions.scalars import align_day
from tramline.operators.scan import DAY, Buckets
from tramline.profile import Profile


def drop_jumps(track: DataFrame, origin: DataFrame, p: Profile, key: str = "tr_id", tie: str = "event_id", width: int = 7 * DAY) -> DataFrame:
    """Fixes without teleports; origin has the key, lat0 and lon0.

    A step is far if it exceeds both jump_min and jump_speed times its duration.
    A fix goes if the steps before and after it are far; the first and last fix
    go if their only step is far and their neighbour stays; all fixes beyond
    center_max of the origin go.  Tracks of fewer than three fixes are returned
    as they are.  A vehicle's fixes are dealt to buckets of `width` seconds; of the
    fixes on their edges the buckets know one another's steps.
    """
    b = Buckets(track.join(origin, key), key, "ts", [tie], width)
    place = F.struct("ts", F.col(tie).alias("tie"), "lat", "lon")

    def far(now: Column, before: Column) -> Column:
        step = planar_m(now["lat"], now["lon"], before["lat"], before["lon"], F.col("lat0"))
        return F.coalesce(step > F.greatest(F.lit(p.jump_min), p.jump_speed * F.abs(now["ts"] - before["ts"])), F.lit(False))

    t = b.df.withColumns({"_at": place, "_prev": F.lag(place).over(b.within), "_rn": F.row_number().over(b.within)})
    # Over the buckets: the fix before each one's first, whether that step is far, and the same of the next bucket.
    some = t.groupBy(key, "_b").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count("*").alias("_n"), F.first("lat0").alias("lat0"))
    some = some.withColumns({"_last_before": F.lag("_last").over(b.over), "_count": F.coalesce(F.sum("_n").over(b.earlier), F.lit(0))})
    some = some.withColumn("_first_far", far(F.col("_first"), F.col("_last_before")))
    known = some.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), "_last_before", "_count", F.lead("_first_far").over(b.over).alias("_next_far"))
    t = t.join(known, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_kb")))
    t = t.withColumns({"far_prev": far(F.col("_at"), F.coalesce("_prev", "_last_before")), "rn": F.col("_count") + F.col("_rn")})
    t = t.withColumn("far_next", F.coalesce(F.lead("far_prev").over(b.within), F.col("_next_far"), F.lit(False)))
    # The first fix goes if only its step is far, the last one likewise: a row per vehicle says whether its neighbour stays.
    total = F.sum("_n")
    ends = some.groupBy(F.col(key).alias("_e")).agg(total.alias("n"))
    edge = t.join(ends, F.col(key) == F.col("_e"))
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("far_prev")))
    rules = edge.where("rn <= 3 OR rn >= n - 1").groupBy(F.col(key).alias("_r")).agg(
        (at(F.lit(2)) & ~F.coalesce(at(F.lit(3)), F.lit(False))).alias("first_goes"), (at(F.col("n")) & ~F.coalesce(at(F.col("n") - 1), F.lit(False))).alias("last_goes")
    )
    edge = edge.join(rules, F.col(key) == F.col("_r"))
    goes = (F.col("far_prev") & F.col("far_next")) | ((F.col("rn") == 1) & F.col("first_goes")) | ((F.col("rn") == F.col("n")) & F.col("last_goes"))
    center = planar_m(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"), F.col("lat0")) <= p.center_max
    return edge.where((F.col("n") < 3) | (~goes & center)).select(*track.columns)


def track_origin(track: DataFrame, key: str = "tr_id") -> DataFrame:
    return track.groupBy(key).agg(F.median("lat").alias("lat0"), F.median("lon").alias("lon0"))


def unit_map(traffic: DataFrame) -> DataFrame:
    """The vehicle that each unit reports for most often; ties go to the smaller id."""
    n = traffic.groupBy("unit_id", "tr_id").agg(F.count("*").alias("n"))
    return n.groupBy("unit_id").agg(F.max(F.struct("n", (-F.col("tr_id")).alias("m"))).alias("x")).select("unit_id", (-F.col("x.m")).alias("tr_id"))


def bind(records: DataFrame, units: DataFrame, ref_s: int) -> DataFrame:
    """Records with tr_id (the unit itself where it is unknown) and ts moved by whole days to the day around ref_s."""
    known = records.drop("tr_id").join(units, "unit_id", "left")
    return known.withColumns({"tr_id": F.coalesce("tr_id", "unit_id"), "ts": align_day(F.col("ts"), F.lit(ref_s))})


def median_plan(schedule: DataFrame) -> int:
    return int(schedule.agg(F.median("plan_s")).first()[0])
