"""The tick: each vehicle's recent fixes as keyed state, its features now, their scores, and the board that is published."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tramline.operators import app, features
from tramline.profile import Profile
from tramline.session import shared_dir
from tramline.streaming.history import active, histories, keyed_state
from tramline.streaming.positions import publish

FIXES = "fixes"


def counted(stream: DataFrame) -> DataFrame:
    """The stream, whose records and valid fixes are counted as they pass (observed metrics)."""
    return stream.observe(FIXES, F.count("*").alias("records"), F.count_if(F.coalesce(F.col("location_valid"), F.lit(False))).alias("valid"))


@dataclass
class Ticks:
    """Predicts for every active vehicle at every tick and writes the snapshot board.

    schedule and priors are the tables that the features need.  score turns a
    table of features into one with pred_s; a column does for a formula.  The
    fixes of keep_s seconds of event time are the state of a streaming query, by
    vehicle; a tick reads those of the active vehicles and writes its board, so a
    tick that runs again after a failure writes the same folder.
    """

    schedule: DataFrame
    priors: DataFrame
    profile: Profile
    score: Callable[[DataFrame], DataFrame] | Column
    keep_s: int
    folder: str = ""
    last: int | None = None  # the tick written last
    columns: list[str] = field(default_factory=lambda: ["event_id", "tr_id", "ts", "lat", "lon", "speed", "location_valid"])

    def __post_init__(self) -> None:
        self.folder = self.folder or f"{shared_dir(self.schedule.sparkSession)}/ticks-{uuid.uuid4().hex}"

    def start(self, stream: DataFrame, every: str | None = "5 seconds", late: str = "1 minute") -> StreamingQuery:
        """Runs the ticks over a stream with the columns and event_time; without a period, over all that is there.

        The same folder goes on where it was left.  What came in is counted on the
        way (observed metrics `fixes`), without a scan of its own.
        """
        with keyed_state(stream.sparkSession):
            return publish(histories(counted(stream), self.columns, self.keep_s, self.profile.active, late), self, f"{self.folder}/state", every)

    def board(self, fixes: DataFrame) -> DataFrame:
        """The ranked snapshot of all vehicles that are active at the newest fix."""
        now = fixes.agg(F.max("ts")).first()[0] or 0
        seen = active(fixes, now, self.keep_s)
        points = app.active_vehicles(seen, now, self.profile).select(
            F.col("tr_id").alias("sample_id"), "tr_id", F.lit(now).cast("long").alias("t"), F.lit(None).cast("double").alias("cur_dev_s")
        )
        table = features.full_table(points, seen, self.schedule, self.priors, self.profile)
        scored = table.withColumn("pred_s", self.score) if isinstance(self.score, Column) else self.score(table)
        ids = {c: F.col(c).cast("long") for c in ("tr_id", "target_stop_id", "stops_left_in_trip")}
        return app.snapshot(scored.withColumns(ids), F.col("pred_s"), self.profile)

    def __call__(self, batch: DataFrame, number: int) -> None:
        fixes = batch.persist()  # the state is read and changed once
        self.board(fixes).write.mode("overwrite").parquet(f"{self.folder}/board/{number}")
        fixes.unpersist()
        self.last = number

    def published(self, number: int) -> DataFrame:
        """The board of a tick."""
        return self.schedule.sparkSession.read.parquet(f"{self.folder}/board/{number}")


class Counts(StreamingQueryListener):
    """Running sums of a query's observed metrics, as its batches end."""

    def __init__(self, name: str = FIXES) -> None:
        self.name, self.total, self.batches = name, Counter(), set()

    def add(self, batch: int, metrics: dict) -> None:
        """A batch that is told twice counts once."""
        if self.name in metrics and batch not in self.batches:
            self.batches.add(batch)
            self.total.update({k: v or 0 for k, v in metrics[self.name].asDict().items()})

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.add(event.progress.batchId, event.progress.observedMetrics)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def observed(query: StreamingQuery, name: str = FIXES) -> Counter:
    """The sums of the batches that a query still remembers."""
    counts = Counts(name)
    for p in query.recentProgress:
        counts.add(p.batchId, p.observedMetrics)
    return counts.total
