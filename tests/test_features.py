"""Deviations at a point of a vehicle with very many stops, and along matched tracks."""

from __future__ import annotations

import math

import pytest

from tramline.operators import features
from tramline.profile import ONLINE

T0 = 1_700_000_000
FIXES = "event_id long, tr_id long, ts long, location_valid boolean, lat double, lon double, speed double"
STOPS = "tt_action_item_id long, tr_id long, plan_s long, stop_lat double, stop_lon double"


def test_deviations_of_a_vehicle_with_a_hundred_thousand_stops(spark):
    """One place, a stop every 400 seconds, each passed i % 7 seconds late: what a point reads does not grow with the history."""
    n = 100_000
    stops = spark.range(n).selectExpr("id + 1 AS tt_action_item_id", "1L AS tr_id", f"{T0} + 400 * id AS plan_s", "55.75D AS stop_lat", "37.6D AS stop_lon")
    fixes = spark.range(n).selectExpr("id AS event_id", "1L AS tr_id", f"{T0} + 400 * id + id % 7 AS ts", "true AS location_valid", "55.75D AS lat", "37.6D AS lon", "8.0D AS speed")
    asked = [(i, 1, T0 + t) for i, t in enumerate([-5, 0, 29, 30, 430, 2_035, 20_000_001, 39_999_999, 50_000_000])]
    points = spark.createDataFrame(asked, "sample_id long, tr_id long, t long")
    got = {r.sample_id: r for r in features.deviation_features(points, fixes, stops, ONLINE).collect()}
    for i, _, t in asked:
        last = min(n, (t - T0 - ONLINE.plan_lead) // 400 + 1)  # stops that are known
        d = [k % 7 for k in range(max(0, last - 5), max(0, last))]
        r = got[i]
        assert r.n_matched_60m == r.n_matched_30m == max(0, last)
        assert r.est_dev_last == (d[-1] if d else None)
        assert r.est_dev_mean3 == (pytest.approx(sum(d[-3:]) / len(d[-3:])) if d else None)
        assert r.time_since_match_s == (t - T0 - 400 * (last - 1) if d else None)
    # No join gives more rows than a few for each point and the pairs of stops and fixes nearby.
    plan = features.deviation_features(points, fixes, stops, ONLINE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") >= 3


def test_passages_along_a_track_refine_delays(spark):
    """A passage between two fixes counts before the fixes nearby, from the step's end on."""
    metre = 1 / 111_132.0
    stops = spark.createDataFrame([(1, 1, T0 + 100, 55.75, 37.6), (2, 1, T0 + 400, 55.75 + 2000 * metre, 37.6)], STOPS)
    fixes = spark.createDataFrame([(1, 1, T0 + 90, True, 55.75 - 40 * metre, 37.6, 8.0), (2, 1, T0 + 110, True, 55.75 + 60 * metre, 37.6, 8.0), (3, 1, T0 + 420, True, 55.75 + 1990 * metre, 37.6, 8.0)], FIXES)
    steps = spark.createDataFrame([(1, T0 + 90, 55.75 - 40 * metre, 37.6, T0 + 110, 55.75 + 60 * metre, 37.6)], "tr_id long, ts long, lat double, lon double, n_ts long, n_lat double, n_lon double")
    points = spark.createDataFrame([(i, 1, T0 + t) for i, t in enumerate((129, 130, 600))], "sample_id long, tr_id long, t long")
    plain = {r.sample_id: r for r in features.deviation_features(points, fixes, stops, ONLINE).collect()}
    finer = {r.sample_id: r for r in features.deviation_features(points, fixes, stops, ONLINE, steps).collect()}
    assert [plain[i].est_dev_last for i in range(3)] == [None, -10.0, 20.0]
    assert finer[0].est_dev_last is None and finer[1].est_dev_last == pytest.approx(-2.0, abs=0.01)  # 40 of 100 metres in 20 seconds
    assert finer[2].est_dev_last == 20.0 and finer[2].est_dev_slope == pytest.approx(22.0, abs=0.01) and finer[2].n_matched_60m == 2
    assert not math.isnan(finer[2].est_dev_std5)
