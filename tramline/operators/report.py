"""Figures on tracks, schedules and predictions: extents, summaries, counters, shares and short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(schedule: DataFrame, pad: float = 0.02) -> DataFrame:
    """The box around all stops, widened by pad degrees, and the number of vehicles: south, west, north, east, vehicles."""
    return schedule.agg(
        (F.min("stop_lat") - pad).alias("south"), (F.min("stop_lon") - pad).alias("west"), (F.max("stop_lat") + pad).alias("north"), (F.max("stop_lon") + pad).alias("east"),
        F.count_distinct("tr_id").alias("vehicles"),
    )


def describe(df: DataFrame, column: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """n, mean, std, least, largest and the interpolated percentiles p25, p50, ... of a column; nulls don't count."""
    c = F.col(column).cast("double")
    return df.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("largest"),
        *(F.percentile(c, F.lit(s)).alias(f"p{round(100 * s)}") for s in shares),
    )


def largest_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """The largest absolute difference of two columns."""
    return df.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("largest_difference"))


def counters(traffic: DataFrame, predictions: DataFrame) -> DataFrame:
    """What a service reports of itself: records, valid ones, vehicles, the last time, predictions and what they lack."""
    seen = traffic.agg(F.count("*").alias("records"), F.count_if("location_valid").alias("valid"), F.count_distinct("tr_id").alias("vehicles"), F.max("ts").alias("last_ts"))
    made = predictions.agg(F.count("pred_s").alias("predicted"), F.count_if(F.col("pred_s").isNull()).alias("not_predicted"))
    return seen.join(made)  # one row each


def fallback_shares(segments: DataFrame, found: Column, key: str = "tr_id") -> DataFrame:
    """Segments of each vehicle, those without a way of their own, and their share in percent; a null key for all vehicles."""
    return segments.rollup(key).agg(F.count("*").alias("segments"), F.count_if(~F.coalesce(found, F.lit(False))).alias("fallbacks")).withColumn("percent", F.round(100 * F.col("fallbacks") / F.col("segments"), 2))


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows by an order, as a heap of k rows per task and one merge; the order should end with a key."""
    return df.orderBy(*order).limit(k)


def label_times(labels: DataFrame, time: str = "t") -> DataFrame:
    """The distinct times of the labels in ascending order."""
    return labels.select(time).where(F.col(time).isNotNull()).distinct().orderBy(time)


def scaled(df: DataFrame, scales: dict[str, float]) -> DataFrame:
    """df with each named column divided by its constant; missing values become 0."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double") / k, F.lit(0.0)), F.lit(0.0)) for c, k in scales.items()})
