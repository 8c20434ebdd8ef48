"""Positions as a stream: tumbling, sliding and session windows, vehicle state, snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tramline.sources import ndtp


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive; a replay takes them a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def positions(frames: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Decoded positions of a stream of frames with event_time, bound to vehicles where a unit map is given."""
    p = ndtp.decode(frames).withColumn("event_time", F.timestamp_seconds("ts"))
    if units is None:
        return p.withColumn("tr_id", F.col("unit_id"))
    return p.join(units, "unit_id", "left").withColumn("tr_id", F.coalesce("tr_id", "unit_id"))


def tumbling(stream: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Fixes and mean speed per vehicle and event-time window; with slide windows overlap."""
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    g = stream.withWatermark("event_time", late).groupBy(w, "tr_id").agg(F.count("*").alias("n"), F.sum("speed_c").alias("speed_sum_c"))
    return g.select("tr_id", F.unix_seconds("window.start").alias("start_s"), "n", "speed_sum_c")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a vehicle: its fixes with pauses shorter than gap."""
    # Session windows that touch are merged, so a window ends a microsecond before the gap does.
    g = stream.withWatermark("event_time", late).groupBy(F.session_window("event_time", f"{gap} -1 microseconds"), "tr_id").agg(F.count("*").alias("n"))
    end = F.unix_seconds(F.col("session_window.end") + F.expr("INTERVAL 1 MICROSECOND"))
    return g.select("tr_id", F.unix_seconds("session_window.start").alias("start_s"), end.alias("end_s"), "n")


_STATE = "last_ts long, last_lat double, last_lon double, total long, valid long"
_LATEST = "tr_id long, last_ts long, last_lat double, last_lon double, total long, valid long"


def vehicle_state(stream: DataFrame, late: str = "1 hour", keep_s: int = 3600) -> DataFrame:
    """Per vehicle its last valid fix by event time and its counts so far, in update mode.

    The state is one row per vehicle, whatever the number of fixes, and expires
    keep_s seconds of event time after the last one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ts, lat, lon, total, valid = state.get if state.exists else (None, None, None, 0, 0)
        newest = ts or 0
        for pdf in batches:
            total += len(pdf)
            good = pdf[pdf["location_valid"].fillna(False).astype(bool) & pdf["lat"].notna()].sort_values(["ts", "lat", "lon"])
            valid += len(good)
            newest = max(newest, int(pdf["ts"].max()))
            if len(good) and (ts is None or int(good["ts"].iloc[-1]) >= ts):
                ts, lat, lon = int(good["ts"].iloc[-1]), float(good["lat"].iloc[-1]), float(good["lon"].iloc[-1])
        state.update((ts, lat, lon, total, valid))
        state.setTimeoutTimestamp(max(newest * 1000, state.getCurrentWatermarkMs()) + keep_s * 1000)
        yield pd.DataFrame({"tr_id": [key[0]], "last_ts": pd.array([ts], "Int64"), "last_lat": [lat], "last_lon": [lon], "total": [total], "valid": [valid]})

    return stream.withWatermark("event_time", late).groupBy("tr_id").applyInPandasWithState(step, _LATEST, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def publish(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Call sink(batch, number) at each tick; without a period, once for all that is there."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()
