"""Map matching: the lattice against all paths, and a stream in any cut against the batch."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.functions.geo import LAT_M
from tramline.operators import lattice, scan, track
from tramline.operators.lattice import Lattice, Net, Rule
from tramline.streaming import snapping

RULE = Rule(apart=1, gap=100, wait=20, wait_most=60, lag=400)


def town(r: random.Random, side: int = 5) -> tuple[list[tuple], list[tuple]]:
    nodes = [(10 * i + j, 55.75 + 0.0012 * i + r.uniform(-2e-4, 2e-4), 37.6 + 0.002 * j + r.uniform(-3e-4, 3e-4)) for i in range(side) for j in range(side)]
    ids = {n[0] for n in nodes}
    edges = [(a, b) for a in ids for b in (a + 1, a + 10) if b in ids and r.random() < 0.85]
    return nodes, edges


def near(nodes: list[tuple], edges: list[tuple]) -> list[dict]:
    at = {n: (la, lo) for n, la, lo in nodes}
    return [{"u": u, "v": v, "ulat": at[u][0], "ulon": at[u][1], "vlat": at[v][0], "vlon": at[v][1]} for u, v in edges]


def drive(r: random.Random, n: int, start: int = 0) -> list[tuple]:
    lat, lon, ts, out = 55.7505, 37.601, start, []
    for _ in range(n):
        lat, lon, ts = lat + r.uniform(-0.0006, 0.0008), lon + r.uniform(-0.001, 0.0012), ts + r.randrange(1, 30)
        out.append((ts, min(max(lat, 55.749), 55.757), min(max(lon, 37.599), 37.611)))
    return out


def all_paths(net: Net, fixes: list[tuple], rule: Rule) -> tuple[float, tuple]:
    """The best sum over every choice of a candidate for every fix; of equal ones the first."""
    columns = [net.candidates(lon * rule.lon_m, lat * LAT_M, rule) for _, lat, lon in fixes]
    best = (-math.inf, ())
    for path in itertools.product(*columns):
        total = 0.0
        for i, s in enumerate(path):
            total -= s[3] ** 2 / (2 * rule.noise**2)
            if i:
                (_, a, b), (_, c, d) = fixes[i - 1], fixes[i]
                straight = math.hypot((d - b) * rule.lon_m, (c - a) * LAT_M)
                length = net.route(path[i - 1], s, 2 * straight + 4 * rule.radius)[0]
                total -= abs(length - straight) / rule.beta
        if total > best[0] + 1e-6:
            best = (total, path)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_lattice_against_all_paths(seed):
    r = random.Random(seed)
    nodes, edges = town(r, 4)
    rule = Rule(apart=1, gap=1000, most=4, lag=400)
    roads = near(nodes, edges)
    fixes = drive(r, 6)
    one = Lattice(rule)
    rows = [x for f in fixes for x in one.push(*f, roads)] + one.finish()
    assert len(rows) == len(fixes) and [x[-1] for x in rows] == [True] + [False] * 5
    net = Net(lattice._edges(roads, rule))
    want, path = all_paths(net, fixes, rule)

    def worth(states: list[tuple]) -> float:
        total = 0.0
        for i, s in enumerate(states):
            total -= s[3] ** 2 / (2 * rule.noise**2)
            if i:
                (_, a, b), (_, c, d) = fixes[i - 1], fixes[i]
                straight = math.hypot((d - b) * rule.lon_m, (c - a) * LAT_M)
                total -= abs(net.route(states[i - 1], s, 2 * straight + 4 * rule.radius)[0] - straight) / rule.beta
        return total

    got = [next(c for c in net.candidates(f[2] * rule.lon_m, f[1] * LAT_M, rule) if c[:3] == x[5:8]) for f, x in zip(fixes, rows, strict=True)]
    assert worth(got) == pytest.approx(want, abs=1e-5)
    length = {(min(u, v), max(u, v)) for u, v in edges}
    for a, b in zip(rows, rows[1:], strict=False):  # the nodes passed are a way from edge to edge
        via = b[8]
        assert (not via and a[5:7] == b[5:7]) or (via[0] in a[5:7] and via[-1] in b[5:7] and all((min(p, q), max(p, q)) in length for p, q in zip(via, via[1:], strict=False)))


def test_lattice_goes_on_from_its_text():
    """Saved and loaded at every fix, with a short lag and parts off the roads, the rows are the same; open columns are bounded."""
    r = random.Random(9)
    nodes, edges = town(r)
    roads = near(nodes, edges)
    for lag in (3, 400):
        rule = Rule(apart=5, gap=100, wait=20, wait_most=60, lag=lag)
        fixes = drive(r, 60) + drive(r, 60, 3000)
        asked = [(*f, None if 25 < i < 32 else roads) for i, f in enumerate(fixes)]
        one = Lattice(rule)
        want = [x for f in asked for x in one.push(*f)] + one.finish()
        text, got, most = None, [], 0
        for f in asked:
            again = Lattice.load(rule, text)
            got += again.push(*f)
            most = max(most, len(again.columns))
            head, tail = len(got), again.tail()
            assert sorted(x[0] for x in got + tail) == [x[0] for x in got + tail]
            text = again.dump()
        got += Lattice.load(rule, text).finish()
        assert got == want and most <= lag + 1 and len(want) > 40
        assert sum(x[-1] for x in want) >= 3  # starts, after the parts off the roads, and after the pause


def test_waiting_after_misses():
    rule = Rule(apart=1, gap=1000, wait=20, wait_most=60)
    one, tried = Lattice(rule), []
    for ts in range(0, 300):
        one.push(ts, 55.0, 37.0, None)
        if one.last_ts == ts:
            tried.append(ts)
    assert tried == [0, 20, 60, 120, 180, 240]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(4)
    nodes, edges = town(r)
    rows = [(v, *f) for v in range(4) for k in range(3) for f in drive(r, 25, 5000 * k + 7 * v)] + [(1, 40, 10.0, 10.0), (2, 41, None, 37.6)]
    return (
        spark.createDataFrame(rows, "tr_id long, ts long, lat double, lon double"),
        spark.createDataFrame(nodes, "node_id long, lat double, lon double"),
        spark.createDataFrame([(u, v, 1.0) for u, v in edges], "u long, v long, length_m double"),
        near(nodes, edges),
    )


def test_match_tracks(spark, data):
    """The same as the lattice with all roads at every fix, as all are within reach of the cells around."""
    fixes, nodes, edges, roads = data
    got = sorted(tuple(x) for x in lattice.match_tracks(fixes, nodes, edges, RULE).collect())
    want = []
    for v in range(4):
        one, last = Lattice(RULE), None
        for x in sorted(fixes.where(f"tr_id = {v} AND lat IS NOT NULL").collect(), key=lambda x: (x.ts, x.lat, x.lon)):
            if x.ts != last:
                want += [(v, *r) for r in one.push(x.ts, x.lat, x.lon, roads if x.lat > 50 else None)]
            last = x.ts
        want += [(v, *r) for r in one.finish()]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    same = sum(a[6:8] == b[6:8] for a, b in zip(got, sorted(want), strict=True))
    assert same >= 0.97 * len(want)  # ways may leave the cells around two fixes
    assert lattice.match_tracks(fixes.limit(0), nodes, edges, RULE).collect() == []
    assert lattice.match_tracks(fixes, nodes.limit(0), edges, RULE).collect() == []


def _run(spark, folder, fixes, files, nodes, edges, seed):
    """The stream over the fixes dealt to files, in random order within 60 seconds, and a last fix far later."""
    r = random.Random(seed)
    rows = sorted((x for x in fixes.collect()), key=lambda x: x.ts + r.randrange(0, 30))
    size = -(-len(rows) // files)
    schema = "tr_id long, ts long, lat double, lon double"
    for k in range(files):
        spark.createDataFrame([tuple(x) for x in rows[k * size : (k + 1) * size]] or [(99, 0, None, None)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    spark.createDataFrame([(98, 10_000_000, 0.0, 0.0)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("event_time", F.timestamp_seconds("ts"))
    live = snapping.match_stream(stream, nodes, edges, RULE, "60 seconds")
    q = live.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("files", [1, 5])
def test_stream_in_any_cut(spark, data, tmp_path, files):
    fixes, nodes, edges, _ = data
    want = sorted(tuple(x) for x in lattice.match_tracks(fixes, nodes, edges, RULE).collect())
    live = _run(spark, tmp_path, fixes, files, nodes, edges, files)
    assert sorted(tuple(x) for x in live.where("settled").drop("settled", "seq").collect()) == want
    now = snapping.track_now(live)
    assert sorted((x.tr_id, x.ts) for x in now.collect()) == [x[:2] for x in want]
    assert files == 1 or live.where("NOT settled").count() > 0


def test_sessions(spark):
    r = random.Random(2)
    rows = [(r.randrange(3), r.randrange(0, 4000), i) for i in range(400)] + [(7, 5, 1), (None, 3, 2), (None, 900, 3)]
    df = spark.createDataFrame(rows, "tr_id long, ts long, id long")
    for width in (7, 500, 10_000):
        got = {(x.tr_id, x.id): (x.before, x.session, x.place) for x in scan.sessions(df, "tr_id", "ts", ["id"], 25, width).collect()}
        last, count, n = {}, {}, {}
        for tr, ts, i in sorted(rows, key=lambda x: (x[1], x[2])):
            before = ts - last[tr] if tr in last else None
            count[tr] = count.get(tr, 0) + (before is None or before > 25)
            n[tr] = n.get(tr, -1) + 1
            assert got[tr, i] == (before, count[tr], n[tr])
            last[tr] = ts
        assert len(got) == len(rows)


def test_segments_end_with_their_track(spark):
    rows = [(1, 10, 1.0, 1.0, True), (1, 20, 2.0, 2.0, False), (1, 90_000, 3.0, 3.0, False), (1, 90_010, 4.0, 4.0, True), (2, 5, 0.0, 0.0, True)]
    got = sorted(tuple(x) for x in lattice.segments(spark.createDataFrame(rows, "tr_id long, ts long, lat double, lon double, starts boolean")).collect())
    assert [(x[0], x[1], x[4]) for x in got] == [(1, 10, 20), (1, 20, 90_000), (1, 90_000, 90_000), (1, 90_010, 90_010), (2, 5, 5)]
    assert track.passage_delays(spark.createDataFrame([], "tr_id long, ts long, lat double, lon double, n_ts long, n_lat double, n_lon double"), spark.createDataFrame([], "tr_id long, tt_action_item_id long, plan_s long, stop_lat double, stop_lon double")).collect() == []


def test_queries_match_every_vehicle(spark):
    """The stream that is stopped in between gives what the batch gives; every vehicle near the roads is matched, and delays come from its passages."""
    from tramline.plans import roads as plans
    from tramline.profile import FIXTURE as P
    from tramline.sources import fixtures

    sf = "/root/testdata/sf0.001"
    batch = sorted(map(tuple, plans.hmm_snap(spark, sf).collect()))
    assert {x[0] for x in batch} == {r.tr_id for r in fixtures.traffic(spark, sf).where("location_valid").select("tr_id").distinct().collect()}
    assert sorted(map(tuple, plans.hmm_stream(spark, sf).collect())) == batch
    for _, _, lat, lon, raw_lat, raw_lon, *_ in batch:
        assert math.hypot((lat - raw_lat) * LAT_M, (lon - raw_lon) * plans.MATCH.lon_m) <= plans.MATCH.radius
    delays = plans.hmm_stop_delays(spark, sf).collect()
    assert delays and all(abs(r.est_delay_s) <= P.match_window for r in delays)
    plain = plans._base(spark, sf)[2].count()
    assert plans.refined_features(spark, sf).count() == plain


def test_corridor_of_a_vehicle_without_a_number(spark):
    assert scan.sessions(spark.createDataFrame([], "tr_id long, ts long"), "tr_id", "ts", [], 5).collect() == []
