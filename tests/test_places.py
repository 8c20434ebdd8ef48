"""Nearest shapes against all distances."""

from __future__ import annotations

import math
import random

import pytest

from tramline.functions.geo import LAT_M, LON_M
from tramline.operators import places

SCALE = LON_M * math.cos(math.radians(55.75))


def away(p: tuple, s: tuple) -> float:
    x, y = p[1] * SCALE, p[0] * LAT_M
    ax, ay, bx, by = s[1] * SCALE, s[0] * LAT_M, s[3] * SCALE, s[2] * LAT_M
    dx, dy = bx - ax, by - ay
    t = min(max(((x - ax) * dx + (y - ay) * dy) / max(dx * dx + dy * dy, 1e-9), 0), 1)
    return math.hypot(ax + t * dx - x, ay + t * dy - y)


@pytest.mark.parametrize(("own", "cutoff"), [(None, math.inf), (None, 600.0), ("line", math.inf), ("line", 900.0)])
def test_nearest(spark, own, cutoff):
    """Points in the middle of many shapes, far from all, and a long segment whose box is empty but for it."""
    r = random.Random(8)
    near = lambda: (55.75 + r.uniform(-0.01, 0.01), 37.6 + r.uniform(-0.02, 0.02))
    shapes = [(r.randrange(3), i, *near()) for i in range(120)]
    shapes = [(k, i, a, b, a + r.uniform(-1e-3, 1e-3), b + r.uniform(-1e-3, 1e-3)) if i % 3 else (k, i, a, b, a, b) for k, i, a, b in shapes]
    shapes += [(1, 500, 55.70, 37.50, 55.80, 37.70), (2, 501, 56.9, 39.0, 56.9, 39.0), (0, 502, None, 37.0, 55.0, 37.0)]
    points = [(i, r.randrange(4), *near()) for i in range(60)] + [(100, 1, 57.0, 40.0), (101, 2, 30.0, -70.0), (102, 1, 55.79, 37.51), (103, 0, None, 37.0)]
    p = spark.createDataFrame(points, "point_id long, line long, lat double, lon double")
    s = spark.createDataFrame(shapes, "line long, shape_id long, alat double, alon double, blat double, blon double")
    got = {x.point_id: x for x in places.nearest_shape(p, s, 55.75, own, cutoff).collect()}
    want = {}
    for i, k, la, lo in points:
        if la is not None:
            found = [(round(away((la, lo), x[2:]), 6), x[1]) for x in shapes if x[2] is not None and (own is None or x[0] == k)]
            if found and min(found)[0] <= cutoff:
                want[i] = min(found)
    assert {i: (x.dist_m, x.shape_id) for i, x in got.items()} == {i: (pytest.approx(d, abs=2e-6), n) for i, (d, n) in want.items()}
    for i, x in got.items():
        la, lo = next(q[2:] for q in points if q[0] == i)
        assert math.hypot((x.lat - la) * LAT_M, (x.lon - lo) * SCALE) == pytest.approx(x.dist_m, abs=1e-3)


def test_nothing_near(spark):
    p = spark.createDataFrame([(1, 55.0, 37.0)], "point_id long, lat double, lon double")
    none = places.points_as_shapes(spark.createDataFrame([], "place_id long, lat double, lon double"))
    assert places.nearest_shape(p, none, 55.75).collect() == []
    one = places.lines(spark.createDataFrame([(1, 1, 55.0, 37.1), (2, 1, 55.0, 37.2), (2, 2, 55.1, 37.2)], "line long, k long, lat double, lon double"), "line", ["k"])
    assert [(x.line, x.shape_id) for x in one.orderBy("line").collect()] == [(1, 0), (2, 0)]
    assert places.nearest_shape(p.limit(0), one.drop("line"), 55.75).collect() == []


def test_keys_of_few_rows_are_one_group(spark, monkeypatch):
    """Both ways, the pyramid for keys beyond WHOLE and all distances of the others, give the same; an id given twice is one row."""
    r = random.Random(5)
    points = [(i, r.randrange(3), 55.75 + r.uniform(-0.01, 0.01), 37.6 + r.uniform(-0.01, 0.01)) for i in range(80)] + [(5, 1, 55.76, 37.6), (90, None, 55.75, 37.6)]
    shapes = [(i % 3 if i % 40 else None, i % 25, 55.75 + r.uniform(-0.01, 0.01), 37.6 + r.uniform(-0.01, 0.01)) for i in range(120)]
    p = spark.createDataFrame(points, "point_id long, line long, lat double, lon double")
    s = spark.createDataFrame(shapes, "line long, shape_id long, alat double, alon double").selectExpr("*", "alat + 0.001 AS blat", "alon + 0.002 AS blon")
    found = {}
    for most in (0, 60, 65, 10_000):
        monkeypatch.setattr(places, "WHOLE", most)
        found[most] = sorted(map(tuple, places.nearest_shape(p, s, 55.75, "line", 700.0).select("point_id", "shape_id", "dist_m").collect()))
    assert len(found[0]) == 80 and all(rows == found[0] for rows in found.values())
    plan = places.nearest_shape(p, s, 55.75, "line", 700.0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan


def test_points_of_one_place_are_asked_for_once(spark):
    p = spark.createDataFrame([(i, 55.75 + 1e-3 * (i % 4), 37.6) for i in range(200)], "point_id long, lat double, lon double")
    s = places.points_as_shapes(spark.createDataFrame([(i, 55.7 + 1e-3 * i, 37.5) for i in range(90)], "place_id long, lat double, lon double"))
    near = places.nearest_shape(p, s, 55.75)
    assert sorted((x.point_id, x.shape_id) for x in near.collect()) == [(i, 50 + i % 4) for i in range(200)]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[x" in plan  # distinct places
