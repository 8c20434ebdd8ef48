"""Contracts of the telemetry operators on small made-up tracks, frames and roads."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.functions import geo, scalars
from tramline.operators import app, clean, features, graph, matching, model, priors, track, trips
from tramline.profile import FIXTURE, OFFLINE, ONLINE
from tramline.sources import files, fixtures, ndtp

SF = "/root/testdata/sf0.001"
T0 = 1_700_000_000


LAT_M, LON_M = 111_132.0, 111_320.0
HOME = (55.16, 61.4)


def at(east: float, north: float) -> tuple[float, float]:
    """Latitude and longitude of a place in metres from home."""
    return HOME[0] + north / LAT_M, HOME[1] + east / (LON_M * math.cos(math.radians(HOME[0])))


def jump_rule(steps: list[tuple[float, float, float]]) -> list[int]:
    """Which fixes of (seconds, east, north) stay, as the rule says it."""
    n = len(steps)
    far = [False] + [math.hypot(b[1] - a[1], b[2] - a[2]) > max(ONLINE.jump_min, ONLINE.jump_speed * (b[0] - a[0])) for a, b in zip(steps, steps[1:], strict=False)] + [False]
    if n < 3:
        return list(range(n))
    stay = [not (far[i] and far[i + 1]) for i in range(n)]
    stay[0], stay[-1] = not (far[1] and stay[1]), not (far[n - 1] and stay[n - 2])
    return [i for i in range(n) if stay[i] and math.hypot(*steps[i][1:]) <= ONLINE.center_max]


def test_jump_filter(spark):
    """Random drives with jumps of all sizes, at the ends too, against the rule."""
    r = random.Random(21)
    tracks = {k: [] for k in range(60)}
    for k, steps in tracks.items():
        t = east = north = 0.0
        for _ in range(k % 9):
            t, east, north = t + r.choice([7, 45, 200, 2500]), east + r.uniform(-300, 300), north + r.uniform(-300, 300)
            off = r.choice([0, 0, 0, 700, 1500, 9000, 45_000])
            turn = r.uniform(0, 2 * math.pi)
            steps.append((t, east + off * math.cos(turn), north + off * math.sin(turn)))
    rows = [(k, i, int(s[0]), *at(*s[1:])) for k, steps in tracks.items() for i, s in enumerate(steps)]
    origin = spark.createDataFrame([(k, *HOME) for k in tracks], "tr_id long, lat0 double, lon0 double")
    want = {(k, i) for k, steps in tracks.items() for i in jump_rule(steps)}
    for width in (60, 86_400):  # one vehicle in many tasks, and in one
        kept = clean.drop_jumps(spark.createDataFrame(rows, "tr_id long, event_id long, ts long, lat double, lon double"), origin, ONLINE, width=width)
        assert {(x.tr_id, x.event_id) for x in kept.collect()} == want
    assert 50 < len(want) < len(rows)


def frame(unit=40_211, ts=1_652_400_123, lat=-12.0431805, lon=-77.0282364, speed=57, course=384, valid=True):
    a = lambda x, t: np.array([x], t)
    return ndtp.encode(a(unit, "i8"), a(ts, "i8"), a(lat, "f8"), a(lon, "f8"), a(speed, "f8"), a(course, "f8"), a(valid, bool))[0]


def sealed(body: bytearray) -> bytes:
    """A frame whose check sum fits its payload again."""
    body[2:4] = (len(body) - 15).to_bytes(2, "little")
    body[6:8] = int(ndtp.crc16(np.frombuffer(bytes(body[15:]), np.uint8)[None])[0]).to_bytes(2, "big")
    return bytes(body)


def test_frames_in_a_stream():
    """Any cut of a stream with noise between its frames gives the same positions."""
    r = random.Random(5)
    made = [frame(unit=500 + i, lat=r.uniform(-80, 80), lon=r.uniform(-170, 170), speed=i, course=40 * i) for i in range(12)]
    noise = [bytes(r.randrange(256) for _ in range(r.randrange(30))).replace(b"~~", b"~") for _ in made]
    stream = b"".join(n + f for n, f in zip(noise, made, strict=True))
    for step in (1, 13, 52, 53, 400, len(stream)):
        frames, rest = [], b""
        for i in range(0, len(stream), step):
            more, rest = ndtp.split_stream(rest + stream[i : i + step])
            frames += more
        assert frames == made
    unit, ts, lat, lon, valid, speed, heading, altitude, nsat = ndtp.records([frame()])[0]
    assert (unit, ts, valid, speed, heading, altitude, nsat) == (40_211, 1_652_400_123, True, 57.0, 24.0, 150.0, 9)
    assert lat == pytest.approx(-12.0431805, abs=2e-7) and lon == pytest.approx(-77.0282364, abs=2e-7)


def test_damaged_and_odd_frames(spark):
    good = frame()
    for i in (0, 3, 7, 20, 30, len(good) - 1):
        bad = bytearray(good)
        bad[i] ^= 0x15
        assert ndtp.records([bytes(bad)]) == [] and ndtp.split_stream(bytes(bad))[0] == []
    assert ndtp.records([good[:-1], good + b"x", b"", b"~~"]) == []
    hidden = ndtp.records([frame(lat=33.5, lon=151.2, valid=False)])[0]
    assert (hidden[2], hidden[3], hidden[4]) == (pytest.approx(-33.5), pytest.approx(-151.2), False)
    other = bytearray(good)
    other[17] = 3  # another kind of message
    assert ndtp.split_stream(sealed(other))[0] and ndtp.records([sealed(other)]) == []
    cell, extra = good[25:], bytes([8, 1]) + bytes(6)
    several = sealed(bytearray(good[:25] + extra + cell + cell + extra + bytes([77, 0]) + cell))  # the unknown cell 77 ends it
    cut_off = sealed(bytearray(good + cell[:-1]))
    frames = [several, good, cut_off, sealed(other)]
    assert [x[0] for x in ndtp.records(frames)] == [40_211] * 4
    df = spark.createDataFrame([(x,) for x in [several, None, b"", good + b"??" + good, cut_off, bytes(other)]], "frame binary")
    assert ndtp.decode(df).count() == 5
    assert ndtp.decode(df.limit(0)).count() == 0


def test_crc_of_known_text():
    assert int(ndtp.crc16(np.frombuffer(b"123456789", np.uint8)[None])[0]) == 0x4B37


def brute_window(fixes, t, w):
    v = [(ts, x, y, s) for ts, x, y, s in fixes if t - w < ts <= t]
    d = [math.hypot(b[1] - a[1], b[2] - a[2]) for a, b in zip(v, v[1:], strict=False)]
    s = [x[3] for x in v]
    return {
        "npts": len(v), "speed_mean": np.mean(s) if s else None, "speed_std": np.std(s) if len(s) > 1 else None, "speed_max": max(s) if s else None,
        "idle_frac": np.mean([x < 5 for x in s]) if s else None, "travel_m": sum(d) if len(v) > 1 else None, "disp_m": math.hypot(v[-1][1] - v[0][1], v[-1][2] - v[0][2]) if len(v) > 1 else None,
    }


def test_windows_against_brute_force(spark):
    r = random.Random(7)
    data = [(1, i, T0 + sorted(r.sample(range(4000), 200))[i], r.random() > 0.1, 55.75 + r.random() / 100, 37.6 + r.random() / 100, r.random() * 20) for i in range(200)]
    data = [(*d[:2], T0 + 20 * d[1] + r.randrange(20), *d[3:]) for d in data]
    f = spark.createDataFrame(data, "tr_id long, event_id long, ts long, location_valid boolean, lat double, lon double, speed double")
    points = spark.createDataFrame([(i, 1, T0 + 200 * i - 100) for i in range(22)], "sample_id long, tr_id long, t long")
    origin = spark.createDataFrame([(1, 55.75, 37.6)], "tr_id long, lat0 double, lon0 double")
    fixes = [(d[2], (d[5] - 37.6) * 111320 * math.cos(math.radians(55.75)), (d[4] - 55.75) * 111132, d[6]) for d in data if d[3]]
    for row in features.window_features(points, f, origin, ONLINE).collect():
        t = T0 + 200 * row.sample_id - 100
        for w, n in zip(ONLINE.windows, ONLINE.window_names, strict=True):
            for k, v in brute_window(fixes, t, w).items():
                got = row[f"{k}_{n}"]
                assert (got is None) == (v is None) and (v is None or got == pytest.approx(v, abs=1e-6))
        past = [d for d in data if d[2] <= t]
        assert row.valid_rate_all == (pytest.approx(sum(d[3] for d in past) / len(past)) if past else None)


@pytest.mark.parametrize("profile", [ONLINE, OFFLINE])
def test_deviations_against_brute_force(spark, profile):
    r = random.Random(9)
    lat0, lon0 = 55.75, 37.6
    stops = [(100 + i, 1, T0 + 240 * i, lat0 + r.choice([0, 1, 2]) * 1e-3, lon0) for i in range(15)]
    fixes = [(i, 1, T0 + 17 * i, True, lat0 + r.random() * 2e-3, lon0 + r.random() * 5e-4, 8.0) for i in range(220)]
    s = spark.createDataFrame(stops, "tt_action_item_id long, tr_id long, plan_s long, stop_lat double, stop_lon double")
    f = spark.createDataFrame(fixes, "event_id long, tr_id long, ts long, location_valid boolean, lat double, lon double, speed double")
    points = spark.createDataFrame([(i, 1, T0 + 150 * i) for i in range(26)], "sample_id long, tr_id long, t long")
    mid = np.median([x[3] for x in stops])
    scale = 111320 * math.cos(math.radians(mid))
    for row in features.deviation_features(points, f, s, profile).collect():
        t, got = T0 + 150 * row.sample_id, []
        for _, _, plan, la, lo in stops:
            near = [(abs(x[2] - plan), x[2], x[2] - plan) for x in fixes if x[2] <= t and abs(x[2] - plan) <= profile.match_window and math.hypot((x[4] - la) * 111132, (x[5] - lo) * scale) <= profile.match_radius]
            if plan + profile.plan_lead <= t and near:
                got.append((plan, min(near)[2]))
        d = [x[1] for x in got]
        assert row.est_dev_last == (d[-1] if d else None)
        assert row.est_dev_slope == (d[-1] - d[-2] if len(d) > 1 else None)
        assert row.est_dev_mean3 == (pytest.approx(np.mean(d[-3:])) if d else None)
        assert row.est_dev_std5 == (pytest.approx(np.std(d[-5:])) if len(d) > 1 else None)
        assert row.time_since_match_s == (t - got[-1][0] if got else None)
        if profile is ONLINE:
            assert (row.n_matched_30m, row.n_matched_60m) == (sum(abs(x) <= 1800 for x in d), len(d))
        else:
            assert (row.n_matched_30m, row.n_matched_60m) == (sum(p >= t - 1800 for p, _ in got), sum(p >= t - 3600 for p, _ in got))


def test_features_are_69_and_from_the_past(spark):
    f, s = fixtures.traffic(spark, SF), fixtures.schedule(spark, SF)
    p = fixtures.points(f).where("sample_id < 60")
    assert len(features.FEATURES) == 69
    whole = {r.sample_id: r for r in features.full_table(p, f, s, priors.build_priors(s, FIXTURE), FIXTURE).collect()}
    cut_at = sorted(r.t for r in whole.values())[len(whole) // 2]
    half = {r.sample_id: r for r in features.full_table(p, f.where(F.col("ts") <= cut_at), s, priors.build_priors(s, FIXTURE), FIXTURE).collect()}
    same = [i for i, r in whole.items() if r.t <= cut_at]
    assert same and all(half[i] == whole[i] for i in same)


def test_trips(spark):
    s = spark.createDataFrame([(1, 5, 0), (2, 5, 900), (3, 5, 1801), (4, 6, 100)], "tt_action_item_id long, tr_id long, plan_s long")
    got = {r.tt_action_item_id: r for r in trips.with_trips(s, ONLINE).collect()}
    assert [got[i].trip_id for i in (1, 2, 3, 4)] == [1, 1, 2, 1]
    assert [got[i].stops_left_in_trip for i in (1, 2, 3, 4)] == [2, 1, 1, 1]
    assert got[1].planned_gap_prev_s is None and got[3].planned_gap_prev_s == 901 and got[3].stops_before_target == 2


def test_priors_without_own_label(spark):
    s = spark.createDataFrame([(1, "a", 0, 100), (2, "a", 0, 300), (3, "b", 0, 50), (4, "c", 0, 5000), (5, "a", 0, None)], "id long, stop_key string, plan_s long, fact_s long")
    p = priors.build_priors(s, ONLINE)
    assert {r.stop_key: (r.prior_n, r.prior_sum, r.prior_median) for r in p.collect()} == {"a": (2, 400, 200.0), "b": (1, 50, 50.0)}
    got = {r.id: r for r in priors.attach_priors(s.withColumn("own", F.col("fact_s") - F.col("plan_s")), p, "own").collect()}
    assert (got[1].prior_n, got[1].prior_sum, got[1].prior_mean) == (1, 300, 300.0)
    assert (got[3].prior_n, got[3].prior_mean, got[3].prior_known) == (0, None, 1.0)
    assert (got[4].prior_n, got[4].prior_known) == (None, 0.0)
    assert (got[5].prior_n, got[5].prior_sum) == (1, 400)


def test_binding(spark):
    units = spark.createDataFrame([(7, 70), (7, 70), (7, 71), (8, 81), (8, 80)], "unit_id long, tr_id long")
    m = clean.unit_map(units)
    assert {r.unit_id: r.tr_id for r in m.collect()} == {7: 70, 8: 80}
    ref = 1_767_700_000
    rec = spark.createDataFrame([(7, 0, ref), (4312, 0, ref + 31 * 86400), (7, 0, ref + 900), (7, 0, ref - 43200)], "unit_id long, tr_id long, ts long")
    got = [(r.tr_id, r.ts) for r in clean.bind(rec, m, ref).collect()]
    assert sorted(got) == sorted([(70, ref), (4312, ref), (70, ref + 900), (70, ref - 43200)])


def test_what_if_table(spark):
    rows = [(1, 200.0, 899, 5, None), (2, -10.0, 900, 5, None), (3, 100.0, 900, 1, None), (4, 700.0, 700, None, 120.0), (5, None, 700, 3, None)]
    board = spark.createDataFrame(rows, "tr_id long, pred_s double, horizon_s long, stops_left_in_trip long, sched_headway_s double")
    got = {r.tr_id: r for r in app.what_if(board, 2, 20.0, ONLINE).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert [got[i].n_ahead for i in (1, 2, 3, 4)] == [1.0, 2.0, 1.0, 1.0]
    assert [got[i].fleet_n for i in (1, 4)] == [6.0, 30.0]
    assert got[1].whatif_s == pytest.approx(200 - 20 - 0.25 * 0.35 * 200)
    assert got[2].saved_bunching == 0
    one = app.what_if_summary(app.what_if(board.where("tr_id < 4"), 2, 20.0, ONLINE), 2).first()
    assert (one.vehicles, one.headway_before_s, one.headway_after_s) == (3, 600.0, 450.0)


def overpass(path):
    """An avenue that runs 12 blocks east and 10 north, and a nameless lane 700 m south of it; blocks of 80 m."""
    avenue = [at(80.0 * min(i, 12), 80.0 * max(i - 12, 0)) for i in range(23)]
    lane = [at(80.0 * i, -700.0) for i in range(13)]
    nodes = [{"type": "node", "id": i, "lat": a, "lon": o} for i, (a, o) in [*enumerate(avenue, 100), *enumerate(lane, 400)]]
    ways = [
        {"type": "way", "id": 3, "nodes": list(range(100, 123)), "tags": {"highway": "secondary", "name": "Long Avenue"}},
        {"type": "way", "id": 4, "nodes": [*range(400, 413), 77], "tags": {"highway": "service"}},  # node 77 is not in the document
    ]
    path.write_text(json.dumps({"elements": [*ways, *nodes, ways[0]]}))
    return str(path)


def test_road_index(spark, tmp_path):
    doc = overpass(tmp_path / "roads_a.json")
    nodes, edges, ways = files.cached_graph(spark, doc, f"file://{tmp_path}/cache")
    assert nodes.count() == 36 and edges.count() == 2 * (22 + 12) // 2
    again = files.cached_graph(spark, str(tmp_path / "gone.json"), f"file://{tmp_path}/cache")
    assert again[1].count() == edges.count()
    named = graph.named_nodes(ways).join(nodes, "node_id").withColumnRenamed("node_id", "place_id")
    ask = spark.createDataFrame([(1, *at(330.0, 40.0)), (2, *at(330.0, -660.0))], "point_id long, lat double, lon double")
    assert [r.point_id for r in matching.nearest(ask, named, HOME[0], 150.0).collect()] == [1]
    assert files.newest(spark, str(tmp_path)).endswith("roads_a.json")


def test_route(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": i, "lat": a, "lon": o} for i, a, o in ((1, 55.75, 37.6), (2, 55.759, 37.6), (3, 55.768, 37.6), (4, 55.759, 37.61), (9, 55.0, 37.0))] + [{"type": "way", "id": 10, "nodes": [1, 2, 3]}, {"type": "way", "id": 11, "nodes": [2, 4]}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    e = files.read_roads(spark, str(tmp_path / "g.json"))
    nodes = graph.nodes_of(e)
    edges = graph.edges_of(graph.way_nodes(e), nodes)
    pairs = spark.createDataFrame([(1, 3), (1, 9), (2, 2), (3, 4)], "source long, target long")
    got = {(r.source, r.target): r for r in graph.polylines(graph.shortest_paths(edges, pairs.select("source")), nodes, pairs).collect()}
    assert got[1, 3].n == 3 and got[1, 3].dist_m == pytest.approx(2001.5, abs=1)
    assert got[1, 9].n == 2 and got[1, 9].dist_m is None
    assert got[2, 2].n == 2 and got[3, 4].n == 3


def test_unfinished_paths_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "u long, v long, length_m double")
    start = spark.createDataFrame([(0,)], "source long")
    with pytest.raises(ValueError, match="3 rounds"):
        graph.shortest_paths(chain, start, delta_m=1.0, rounds=3)
    got = {r.node: r.dist_m for r in graph.shortest_paths(chain, start, delta_m=1.0, rounds=8).collect()}
    assert got == {i: float(i) for i in range(7)}


@pytest.mark.parametrize("delta", [None, 3.0, 40.0])
def test_paths_against_dijkstra(spark, delta):
    """Random graphs with parallels, loops, ends that don't meet and lengths of all sizes, from several sources, with and without a limit."""
    import heapq

    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(70), r.choice([0.0, 1.0, 2.5, r.uniform(0, 30)])) for _ in range(150)]
    near: dict[int, list] = {}
    for u, v, d in edges:
        near.setdefault(u, []).append((v, d))
        near.setdefault(v, []).append((u, d))

    def dijkstra(start, limit):
        best, queue = {}, [(0.0, start)]
        while queue:
            d, i = heapq.heappop(queue)
            if i not in best:
                best[i] = d
                for j, m in near.get(i, ()):
                    if d + m <= limit:
                        heapq.heappush(queue, (d + m, j))
        return best

    df = spark.createDataFrame(edges, "u long, v long, length_m double")
    starts = [0, 7, 33, 99]
    sources = spark.createDataFrame([(s,) for s in [*starts, 7]] + [(None,)], "source long")
    for limit in ([math.inf, 20.0] if delta is None else [25.0]):
        rows = graph.shortest_paths(df, sources, limit, delta).collect()
        assert len(rows) == len({(x.source, x.node) for x in rows})
        for s in starts:
            want = dijkstra(s, limit)
            got = {x.node: x for x in rows if x.source == s}
            assert {n: x.dist_m for n, x in got.items()} == pytest.approx(want)
            for n, x in got.items():
                assert (x.prev is None) == (n == s) or want[n] == 0.0
                if x.prev is not None:
                    assert any(j == n and want[x.prev] + m == pytest.approx(want[n]) for j, m in near[x.prev])


def moving(seed=11, stuck=0):
    """A drive along the avenue at 9 m/s, a fix every eight seconds, then perhaps a stop at its end."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(24 + stuck):
        d = min(72.0 * i, 1730.0)
        east, north = min(d, 960.0), max(d - 960.0, 0.0)
        off = r.normal(0, 3.0 if i < 24 else 0.8, 2)
        rows.append((1, float(T0 + 8 * i), *map(float, at(east + off[0], north + off[1]))))
    return rows


@pytest.fixture(scope="module")
def roads(spark, tmp_path_factory):
    e = files.read_roads(spark, overpass(tmp_path_factory.mktemp("roads") / "r.json"))
    ways, nodes = graph.way_nodes(e), graph.nodes_of(e)
    return nodes.cache(), graph.edges_of(ways, nodes).cache(), ways.cache()


TRACK = "tr_id long, ts double, lat double, lon double"


def from_home(lat, lon):
    return (lon - HOME[1]) * LON_M * math.cos(math.radians(HOME[0])), (lat - HOME[0]) * LAT_M


def test_snap(spark, roads):
    got = sorted(track.snap(spark.createDataFrame(moving(), TRACK), roads[0], roads[1]).collect(), key=lambda r: r.ts)
    assert len(got) >= 12
    for r in got:  # on one of the avenue's arms, and where the drive was
        east, north = from_home(r.lat, r.lon)
        d = min(9.0 * (r.ts - T0), 1730.0)
        assert min(abs(north), abs(east - 960.0)) < 1.0
        assert math.hypot(east - min(d, 960.0), north - max(d - 960.0, 0.0)) < 30
    far = spark.createDataFrame([(1, float(i), -30.0, 140.0) for i in range(7)], TRACK)
    assert track.snap(far, roads[0], roads[1]).collect() == []


def test_stop_delay_from_snapped_track(spark, roads):
    snapped = track.snap(spark.createDataFrame(moving(), TRACK), roads[0], roads[1])
    # The drive passes 600 m at 67 s; the first stop's plan is 25 s before that, the second lies at the lane.
    stops = spark.createDataFrame([(31, 1, T0 + 42, *at(600.0, 12.0)), (32, 1, T0 + 42, *at(600.0, -690.0))], "tt_action_item_id long, tr_id long, plan_s long, stop_lat double, stop_lon double")
    got = {r.tt_action_item_id: r.est_delay_s for r in track.snapped_delays(snapped, stops).collect()}
    assert set(got) == {31} and got[31] == pytest.approx(25, abs=6)


def test_every_vehicle_has_its_corridor(spark):
    from tramline.plans import roads as plans

    f = fixtures.traffic(spark, SF)
    nodes, edges, _ = plans._grid(spark)
    got = plans.subgraph_corridors(spark, SF).collect()
    assert len({r.tr_id for r in got}) > 1
    third = {(r.u, r.v) for r in graph.corridor(nodes, edges, f.where("tr_id = 3"), 120.0, 55.75)[1].collect()}
    assert {(r.u, r.v) for r in got if r.tr_id == 3} == third
    nobody = graph.corridors(nodes, edges, f.where("tr_id = 3").withColumn("tr_id", F.lit(None).cast("long")), 120.0, 55.75)
    assert {(r.u, r.v) for r in nobody.collect()} == third


def test_standing(spark):
    stood = track.longest_stop(spark.createDataFrame(moving(3, stuck=30), TRACK)).collect()
    assert len(stood) == 1 and stood[0].seconds >= 120
    assert track.longest_stop(spark.createDataFrame(moving(3), TRACK)).collect() == []


def test_thin():
    ts = np.arange(0, 3000, 3, dtype=float)
    kept = track.thin(ts)
    assert kept[0] == 0 and kept[-1] == len(ts) - 1 and len(kept) <= 90
    assert list(track.thin(np.array([5.0]))) == [0] and list(track.thin(np.array([]))) == []
    assert list(track.thin(np.array([0.0, 5.0, 9.0, 10.0, 12.0]))) == [0, 3, 4]


def test_decimated_tracks(spark):
    """Whole tracks, also where a vehicle's rows come in several batches."""
    r = random.Random(2)
    rows = [(k, float(t)) for k, n in ((1, 400), (2, 1), (3, 37), (None, 60)) for t in sorted(r.sample(range(9000), n))]
    df = spark.createDataFrame(rows, "tr_id long, ts double").withColumn("lat", F.col("ts") / 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        for apart, most in ((10.0, 90), (40.0, 1000), (0.5, 7)):
            got = sorted(((x.tr_id or 0, x.ts) for x in track.decimate(df, apart, most, width=50).collect()))
            want = []
            for k in (0, 1, 2, 3):
                ts = np.array([t for i, t in rows if (i or 0) == k])
                want += [(k, float(ts[i])) for i in track.thin(ts, apart, most)]
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert track.decimate(df.limit(0)).collect() == []


def test_smoothed_marker(spark):
    """One vehicle in many tasks, of any length, with missing values."""
    r = random.Random(6)
    rows = [(k, t, None if r.random() < 0.2 or t < 4 else r.uniform(-50, 200)) for k in (1, 2, None) for t in range(0, 300, 1 + (k or 0))]
    df = spark.createDataFrame(rows, "tr_id long, ts long, v double")
    for width in (7, 100_000):
        got = {(x.tr_id, x.ts): x.smooth for x in track.smoothed(df, "tr_id", "ts", "v", 0.0, 100.0, width).collect()}
        mean = {}
        for k, t, v in sorted(rows, key=lambda x: x[1]):
            if v is not None:
                mean[k] = (mean[k] + v) / 2 if k in mean else v
            assert got[k, t] == (pytest.approx(min(max(mean[k], 0.0), 100.0), abs=1e-9) if k in mean else None)
        assert len(got) == len(rows)


def test_cached_scan_and_refreshed_graph(spark, tmp_path):
    import os

    def place(lon):
        (tmp_path / "s.csv").write_text(f'tt_action_item_id,tr_id,time_begin,time_fact_begin,geom\n1,5,2026-01-06 10:00:00,,"POINT ({lon} 55.75)"\n')

    place(61.4)
    path = str(tmp_path / "s.csv")
    a = files.cached_scan(spark, path, files.read_schedule)
    assert files.cached_scan(spark, path, files.read_schedule) is a and a.first().stop_lon == 61.4
    place(61.5)
    os.utime(path, (2_000_000_000, 2_000_000_000))
    b = files.cached_scan(spark, path, files.read_schedule)
    assert b is not a and b.first().stop_lon == 61.5 and not a.is_cached
    doc = overpass(tmp_path / "roads_z.json")
    assert files.cached_graph(spark, doc, f"file://{tmp_path}/again")[0].count() == 36
    (tmp_path / "roads_z.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 55.0, "lon": 61.0}, {"type": "node", "id": 2, "lat": 55.001, "lon": 61.0}, {"type": "way", "id": 9, "nodes": [1, 2]}]}))
    os.utime(doc, (2_000_000_000, 2_000_000_000))
    assert files.cached_graph(spark, doc, f"file://{tmp_path}/again")[0].count() == 2


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "s.csv").write_text('tt_action_item_id,tr_id,time_begin,time_fact_begin,geom\n1,5,2026-01-06 10:00:00,2026-01-06 10:01:40,"POINT (37.6 55.75)"\n2,5,2026-01-06 10:10:00,,"POINT(37.6 55.75)"\n3,5,2026-01-06 10:20:00,soon,x\n')
    got = {r.tt_action_item_id: r for r in files.read_schedule(spark, str(tmp_path / "s.csv")).collect()}
    assert got[1].fact_s - got[1].plan_s == 100 and (got[1].stop_lat, got[1].stop_lon) == (55.75, 37.6) and got[1].stop_key == "55.75000_37.60000"
    assert got[2].fact_s is None and got[2].stop_lat is None and got[3].fact_s is None and got[3].stop_key == "nan_nan"
    (tmp_path / "t.csv").write_text("unit_id,tr_id,event_time,lat,lon,speed,heading,location_valid\n9,5,2026-01-06 10:00:00,55.7,37.6,12.5,90,true\n9,5,2026-01-06 10:00:05,,37.6,,90,\n")
    t = files.read_traffic(spark, str(tmp_path / "t.csv"))
    assert matching.valid_fixes(t).count() == 1 and t.count() == 2
    (tmp_path / "tpl.csv").write_text("sample_id;pred\na;0\nb;0\n")
    template = files.read_template(spark, str(tmp_path / "tpl.csv"))
    with pytest.raises(ValueError, match="without a prediction"):
        files.write_submission(spark.createDataFrame([("a", 1.0)], "sample_id string, pred_s double"), template, f"{tmp_path}/out")
    files.write_submission(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sample_id string, pred_s double"), template, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True, sep=";").count() == 2


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"), geo.angle_between(F.lit(350.0), F.lit(10.0)).alias("a"), scalars.number(F.lit("x")).alias("x"),
        scalars.clamp(F.lit(900.0), -420, 700).alias("c"), scalars.ratio(F.lit(1.0), F.lit(0.0)).alias("r"), geo.valid_heading(F.lit(360.0)).alias("h"), scalars.falsy(F.lit(" No ")).alias("f"),
        geo.in_world(F.lit(91.0), F.lit(0.0)).alias("w"), scalars.finite(F.lit(float("inf"))).alias("i"), geo.bbox_key(F.lit(55.1), F.lit(-37.25), F.lit(56.0), F.lit(38.0)).alias("k"),
    ).first()
    assert (round(got.b, 6), got.a, got.x, got.c, got.r, got.h, got.f, got.w, got.i) == (90.0, 20.0, None, 700.0, None, None, True, False, None)
    assert got.k == "55_1000_m37_2500_56_0000_38_0000"


def test_routes_written_and_read(spark, tmp_path):
    s = fixtures.schedule(spark, SF).where("tr_id < 3")
    r = app.routes(s)
    lines = [json.loads(x.feature) for x in r.collect()]
    (tmp_path / "routes.json").write_text(json.dumps({"features": lines}))
    back = files.read_routes(spark, str(tmp_path / "routes.json"))
    assert back.count() == s.count()


def test_model_round_trip(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, str(i % 7), str(i), f"k{i % 5}", float(r.random()), None if i % 9 == 0 else float(i % 13), 10.0 * (i % 7) + r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id long, tr_id string, target_stop_id string, stop_key string, a double, b double, y double")
    fitted = model.fit(df.where("sample_id % 4 <> 0"), ["a", "b"], "y", trees=10, depth=3)
    model.save(fitted, f"{tmp_path}/m")
    held = df.where("sample_id % 4 = 0").withColumn("tr_id", F.when(F.col("sample_id") == 8, "new").otherwise(F.col("tr_id")))
    a = {x.sample_id: x.pred_s for x in model.score(fitted, held, ONLINE).collect()}
    b = {x.sample_id: x.pred_s for x in model.score(model.load(spark, f"{tmp_path}/m"), held, ONLINE).collect()}
    assert a == b and len(a) == 75
    mae = held.join(spark.createDataFrame(list(a.items()), "sample_id long, p double"), "sample_id").agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0]
    assert mae < 15
    assert len(model.importance(fitted)) == 5


def test_ordered_encodings_and_early_stop(spark):
    """Codes come from earlier rows only, and trees stop where the rows held back gain nothing."""
    import hashlib

    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), None if r.random() < 0.1 else float(r.randrange(100))) for i in range(400)]
    got = {x.id: x.ot_c for x in priors.ordered_encode(spark.createDataFrame(rows, "id long, c string, y double"), "c", "y", "id", 5.0).collect()}
    mean, sums = np.mean([y for *_, y in rows if y is not None]), {}
    for i, c, y in sorted(rows, key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest()):
        n, s = sums.get(c, (0, 0.0))
        assert got[i] == pytest.approx((s + 5 * mean) / (n + 5))
        if y is not None:
            sums[c] = (n + 1, s + y)
    noise = [(i, str(i), str(i), str(i), r.random(), r.random() * 100) for i in range(300)]
    df = spark.createDataFrame(noise, "sample_id long, tr_id string, target_stop_id string, stop_key string, a double, y double")
    stopped = model.fit(df, ["a"], "y", trees=25, depth=2, key="sample_id", validation=F.col("sample_id") % 3 == 0)
    assert stopped.pipeline.stages[-1].getNumTrees < 25


def test_live_sources(spark):
    import socket
    import threading

    from tramline.sources.live import TcpPositions, _TcpReader

    server = socket.create_server(("127.0.0.1", 0))
    data = frame() + frame(unit=5)

    def serve():
        peer, _ = server.accept()
        peer.sendall(data[:30])
        peer.sendall(data[30:])
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    reader = _TcpReader({"host": "127.0.0.1", "port": str(server.getsockname()[1])})
    rows, offset = [], reader.initialOffset()
    for _ in range(5):
        it, offset = reader.read(offset)
        rows += list(it)
    assert [r[0] for r in rows] == [40_211, 5] and offset == {"bytes": len(data)}
    spark.dataSource.register(TcpPositions)
    assert TcpPositions.name() == "ndtp-tcp"
