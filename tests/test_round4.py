"""What the fourth round found: rows that are shuffled, written or matched more often or wider than they need be."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tramline.operators import features, lattice, matching, model
from tramline.plans import catalogue
from tramline.profile import FIXTURE as P
from tramline.streaming import history

SF = "/root/testdata/sf0.001"


def _stages(spark: SparkSession) -> dict[int, int]:
    """Bytes that each stage so far shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}


def _shuffled(spark: SparkSession, run: Callable[[], object]) -> int:
    """Bytes that run() shuffles."""
    before = set(_stages(spark))
    run()
    return sum(v for k, v in _stages(spark).items() if k not in before)


def _street(spark: SparkSession, n: int):
    """n nodes in a row and the edges between them."""
    nodes = spark.createDataFrame([(i, 55.75 + 1e-6 * (i * 7919 % 101), 37.6 + 5e-5 * i) for i in range(n)], "node_id long, lat double, lon double")
    return nodes, spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "u long, v long")


def test_fixes_are_shuffled_without_roads(spark):
    """Every fix went to its task with all roads around it, and to the steps of its track by a second matching."""
    nodes, edges = _street(spark, 60)
    fixes = spark.range(0, 4_000, 1, 4).selectExpr("id % 40 AS tr_id", "20 * (id div 40) AS ts", "55.7501D AS lat", "37.6 + 1e-6 * (id % 977) AS lon")
    matched = lattice.match_tracks(fixes, nodes, edges)
    assert _shuffled(spark, lambda: matched.write.format("noop").mode("overwrite").save()) < 600_000
    columns = [c.split()[0] for c in lattice.SEGMENTS.split(", ")]
    steps = lattice.match_segments(fixes, nodes, edges).select(columns)
    assert sorted(map(tuple, steps.collect())) == sorted(map(tuple, lattice.segments(matched).select(columns).collect()))


def test_steps_of_tracks_that_break(spark):
    """The steps made while matching are those of the matched rows, also at pauses, breaks and the parts' ends."""
    nodes, edges = _street(spark, 60)
    far = F.when(F.col("id") % 7 == 0, 56.5).otherwise(55.7501)  # off every road
    fixes = spark.range(0, 900, 1, 3).select((F.col("id") % 9).alias("tr_id"), (F.col("id") * 13 + F.expr("(id div 90) * 700")).alias("ts"), far.alias("lat"), (F.lit(37.6) + 3e-6 * (F.col("id") % 977)).alias("lon"))
    columns = [c.split()[0] for c in lattice.SEGMENTS.split(", ")]
    for rule in (lattice.Rule(), lattice.Rule(gap=200), lattice.Rule(lag=2)):
        want = lattice.segments(lattice.match_tracks(fixes, nodes, edges, rule)).select(columns)
        got = sorted(map(tuple, lattice.match_segments(fixes, nodes, edges, rule).select(columns).collect()))
        assert len(got) > 50 and got == sorted(map(tuple, want.collect()))


def test_stop_delays_shuffle_narrow_rows(spark):
    """hmm_stop_delays matched all tracks twice, each time with the roads in the shuffled rows."""
    assert _shuffled(spark, lambda: catalogue.QUERIES["hmm_stop_delays"](spark, SF).write.format("noop").mode("overwrite").save()) < 600_000


def test_refined_features_shuffle_narrow_rows(spark):
    """So did refined_features."""
    assert _shuffled(spark, lambda: catalogue.QUERIES["refined_features"](spark, SF)) < 800_000


class _Handle:
    """What a stateful processor is given, with one vehicle's state; counts what is asked of it."""

    def __init__(self) -> None:
        self.rows, self.timers, self.asked = [], set(), 0

    def getListState(self, *_):  # noqa: ANN202, N802
        return self

    def exists(self) -> bool:
        return bool(self.rows)

    def get(self) -> list:
        return list(self.rows)

    def put(self, rows: list) -> None:
        self.rows = list(rows)

    def appendList(self, rows: list) -> None:  # noqa: N802
        self.rows += rows

    def clear(self) -> None:
        self.rows = []

    def listTimers(self) -> list:  # noqa: N802
        self.asked += 1
        return sorted(self.timers)

    def deleteTimer(self, at: int) -> None:  # noqa: N802
        self.timers.remove(at)

    def registerTimer(self, at: int) -> None:  # noqa: N802
        self.timers.add(at)


def test_state_holds_what_ticks_can_use():
    """The first batch of a stream, whose watermark is at nothing, left whole histories in the state and gave them out."""
    columns = ["event_id", "tr_id", "ts", "speed"]
    recent, handle = history.Recent(columns, None, 100, 50), _Handle()
    recent.init(handle)
    mark = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    rows = pd.DataFrame({"event_id": range(200), "tr_id": 1, "ts": range(0, 2_000, 10), "speed": [None, 1.5] * 100})
    (out,) = recent.handleInputRows((1,), iter([rows]), mark(0))
    assert out["ts"].tolist() == list(range(1_900, 2_000, 10)) and handle.rows == list(out.astype(object).where(out.notna(), None).itertuples(index=False, name=None))
    assert handle.asked == 0 and handle.timers == {1}
    handle.timers.clear()  # it goes off
    (out,) = recent.handleExpiredTimer((1,), mark(2_030_000), None)
    assert out["ts"].tolist() == list(range(1_940, 2_000, 10)) == [r[2] for r in handle.rows] and handle.timers == {2_030_001}
    (out,) = recent.handleInputRows((1,), iter([rows.tail(2).assign(event_id=[199, 200], ts=[1_990, 2_035])]), mark(2_030_000))
    assert out["event_id"].tolist() == [*range(194, 200), 200] and handle.timers == {2_030_001}
    handle.timers.clear()
    assert list(recent.handleExpiredTimer((1,), mark(9_000_000), None)) == [] and handle.rows == [] and not handle.timers


def test_windows_are_not_dealt_anew_for_what_was_before(spark):
    """The join that took missing vehicles as equal dealt the windows' wide rows a second time."""
    traffic = spark.createDataFrame([(1, 7, 10, 55.0, 37.0, 1.0, True), (2, None, 20, 55.0, 37.1, 2.0, True), (3, None, 90_000, 55.0, 37.2, 3.0, True), (4, 0, 30, 55.0, 37.3, 4.0, True)], "event_id long, tr_id long, ts long, lat double, lon double, speed double, location_valid boolean")
    points = traffic.selectExpr("event_id AS sample_id", "tr_id", "ts + 86400 * 3 AS t")
    origin = spark.createDataFrame([(7, 55.0, 37.0)], "tr_id long, lat0 double, lon0 double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (matching.last_fix(points, traffic), features.window_features(points, traffic, origin, P)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning(coalesce" in line]
            assert {r.sample_id: r.fix.speed for r in df.collect()} == {1: 1.0, 2: 3.0, 3: 3.0, 4: 4.0}
        assert {(r.sample_id, r.tr_id) for r in matching.last_fix(points, traffic).collect()} == {(1, 7), (2, None), (3, None), (4, 0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_codes_meet_narrow_rows(spark):
    """Each category's codes were joined to rows with all numbers; both ways give the same."""
    rows = spark.createDataFrame([(i, str(i % 3), str(i % 4), f"k{i % 2}", i / 2) for i in range(20)], "sample_id long, tr_id string, target_stop_id string, stop_key string, speed double")
    codes = {c: rows.select(c, F.length(c).cast("double").alias(f"e_{c}")).distinct().where(F.col(c) != "1") for c in model.CATEGORIES}
    got = model.prepared(rows, ["speed"], codes, 0.5, "sample_id")
    assert sorted(map(tuple, got.select(sorted(got.columns)).collect())) == sorted(map(tuple, model.prepared(rows, ["speed"], codes, 0.5).select(sorted(got.columns)).collect()))


def test_fewer_ways_are_looked_at(monkeypatch):
    """Each of a fix's states was reached from all states before it."""
    rule, asked, whole = lattice.Rule(), [], lattice.Net.shortest
    monkeypatch.setattr(lattice.Net, "shortest", lambda self, *a: asked.append(1) or whole(self, *a))
    grid = [(8 * i + j, 8 * i + j + d) for i in range(8) for j in range(8) for d in (1, 8) if (j < 7 if d == 1 else i < 7)]
    at = lambda n: (55.745 + 0.0015 * (n // 8), 37.594 + 0.002 * (n % 8))
    here = lattice._edges([{"u": u, "v": v, "ulat": at(u)[0], "ulon": at(u)[1], "vlat": at(v)[0], "vlon": at(v)[1]} for u, v in grid], rule)
    one, rows = lattice.Lattice(rule), []
    for k in range(40):
        rows += one.push(20 * k, 55.7451 + 1e-4 * (k * 37 % 100), 37.5941 + 1e-4 * (k * 53 % 130), here)
    assert len(rows + one.finish()) == 40 and len(asked) < 39 * 60
