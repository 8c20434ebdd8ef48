"""The tick job, on-route places, and figures on odd tables."""

from __future__ import annotations

import math
import random
import socket
import threading
from collections import Counter

from pyspark.sql import functions as F

from tramline.operators import matching, priors, report
from tramline.plans.telemetry import _score
from tramline.profile import FIXTURE as P
from tramline.sources import fixtures, ndtp
from tramline.sources.live import TcpPositions
from tramline.streaming.history import histories, keyed_state
from tramline.streaming.online import Counts, Ticks
from tramline.streaming.positions import publish, vehicle_state

SF = "/root/testdata/sf0.001"

def test_ticks_in_any_cut_give_the_same_board(spark, tmp_path):
    """The last board does not depend on how the fixes were dealt to ticks, on repeated fixes, or on the query being stopped in between."""
    s = fixtures.schedule(spark, SF).withColumns({c: F.col(c) + 172_800 for c in ("plan_s", "fact_s")})
    p = priors.build_priors(s, P)

    def boards(batches, name):
        ticks = Ticks(s, p, P, _score(), P.windows[-1] + P.match_window, f"{tmp_path}/{name}")
        for batch in batches:
            batch.write.mode("append").parquet(f"{tmp_path}/{name}/in")
            ticks.start(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/{name}/in"), every=None).awaitTermination()
        return sorted(map(tuple, ticks.published(ticks.last).drop("sched_headway_s").collect()))

    f = fixtures.traffic(spark, SF).select("event_id", "tr_id", "ts", "lat", "lon", "speed", "location_valid").withColumn("event_time", F.timestamp_seconds("ts"))
    cut = f.agg(F.percentile_approx("ts", 0.9)).first()[0]
    early, late = f.where(F.col("ts") <= cut), f.where(F.col("ts") > cut)
    whole = boards([f], "one")
    assert len(whole) > 3
    assert boards([early, late.union(late.limit(20))], "two") == whole


def test_histories_are_bounded_and_expire(spark, tmp_path):
    """Forty ticks of a minute: state and output stay as large as five minutes of fixes, a vehicle that falls silent leaves both, and a restart goes on."""
    columns = ["event_id", "tr_id", "ts", "lat"]
    schema = "event_id long, tr_id long, ts long, lat double"
    seen, parts = {}, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")

    def sink(batch, number):
        seen[number] = Counter((r.tr_id for r in batch.collect()))

    def run(minutes):
        for k in minutes:
            rows = [(10 * k + v, v, 60 * k + v, 1.0) for v in (1, 2, 3) if v != 3 or k < 12] + [(10 * k + 1, 1, 60 * k + 1, 1.0)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("event_time", F.timestamp_seconds("ts"))
        with keyed_state(spark):
            q = publish(histories(stream, columns, 300, 120, "0 seconds"), sink, f"{tmp_path}/state", None)
            q.awaitTermination()
        return q

    try:
        run(range(1, 21))
        silent = [n for n in seen if seen[n][3]]
        assert silent and max(silent) < 17  # given out for two minutes after its last fix, at the watermark's pace
        q = run(range(21, 41))
        assert len(seen) >= 40 and all(max(c.values(), default=0) <= 8 for c in seen.values())
        assert all(seen[n][1] and seen[n][2] for n in sorted(seen)[:40])
        left = spark.read.format("statestore").option("stateVarName", "fixes").load(f"{tmp_path}/state")
        assert {r.tr_id for r in left.select("key.tr_id").distinct().collect()} == {1, 2}
        rows = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
        assert max(rows) <= 2 * min(x for x in rows if x) + 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_counts_of_a_stream():
    class Row:
        def __init__(self, **k):
            self.k = k

        def asDict(self):  # noqa: N802
            return self.k

    c = Counts("fixes")
    for batch, metrics in ((0, {"fixes": Row(records=3, valid=2)}), (1, {}), (0, {"fixes": Row(records=3, valid=2)}), (2, {"fixes": Row(records=4, valid=None)})):
        c.add(batch, metrics)
    assert c.total == Counter(records=7, valid=2)


def test_on_route_places(spark):
    r = random.Random(3)
    vertices = [(i, 55.75 + r.random() / 100, 37.6 + r.random() / 50) for i in range(40)]
    fixes = [(i, i % 4, 86_400 * (i // 60) + 37 * i, 55.745 + r.random() / 40, 37.595 + r.random() / 25) for i in range(200)]
    scale, last, want = 111_320.0 * math.cos(math.radians(55.75)), {}, {}
    for i, tr, _, lat, lon in sorted(fixes, key=lambda x: x[2]):
        near = sorted((math.hypot((a - lat) * 111_132.0, (o - lon) * scale), v, a, o) for v, a, o in vertices)
        near = [x for x in near if x[0] <= 300.0][:3]
        if near:
            before = last.get(tr)
            best = near[0] if before is None else min(near, key=lambda x: (x[2] - before[0]) ** 2 + (x[3] - before[1]) ** 2)
            last[tr] = best[2:]
        want[i] = (*last.get(tr, (None, None)), len(near))
    for width in (300, 86_400):
        places = matching.on_route(spark.createDataFrame(fixes, "point_id long, tr_id long, ts long, lat double, lon double"), spark.createDataFrame(vertices, "place_id long, lat double, lon double"), 55.75, 300.0, k=3, width=width)
        got = {x.point_id: (x.route_lat, x.route_lon, x.near) for x in places.collect()}
        assert got == want
    assert any(n == 0 and a is not None for a, _, n in got.values()) and any(a is None for a, *_ in got.values())


def test_report_on_nothing(spark):
    none = spark.createDataFrame([], "tr_id long, stop_lat double, stop_lon double, v double, t long")
    assert report.bounds(none).first().vehicles == 0
    assert report.describe(none, "v").first().n == 0
    assert report.label_times(none).collect() == [] and report.top(none, 3, "tr_id").collect() == []
    some = spark.createDataFrame([(1, float("nan"), None), (1, 30.0, 3.0), (2, None, 9.0)], "tr_id long, a double, b double")
    assert [(x.a, x.b) for x in report.scaled(some, {"a": 10.0, "b": 3.0}).collect()] == [(0.0, 0.0), (3.0, 1.0), (0.0, 3.0)]
    shares = {x.tr_id: (x.segments, x.fallbacks, x.percent) for x in report.fallback_shares(some, F.col("b") > 5).collect()}
    assert shares == {1: (2, 2, 100.0), 2: (1, 0, 0.0), None: (3, 2, 66.67)}


def test_frames_sent_over_tcp(spark):
    f = fixtures.traffic(spark, SF).where("tr_id < 4").repartition(3)
    server, got = socket.create_server(("127.0.0.1", 0)), []

    def take(peer):
        data = b""
        while piece := peer.recv(1 << 16):
            data += piece
        got.append(data)

    def serve():
        while True:
            threading.Thread(target=take, args=(server.accept()[0],), daemon=True).start()

    threading.Thread(target=serve, daemon=True).start()
    spark.dataSource.register(TcpPositions)
    ndtp.frames_of(f).select("frame").write.format("ndtp-tcp").mode("append").options(host="127.0.0.1", port=server.getsockname()[1], flush=7).save()
    for _ in range(50):
        if len(got) == 3:
            break
        threading.Event().wait(0.1)
    sent = [r for data in got for r in ndtp.records(ndtp.split_stream(data)[0])]
    want = ndtp.decode(ndtp.frames_of(f)).collect()
    assert sorted(sent) == sorted(map(tuple, want)) and len(want) > 0


def test_relays_are_read_again_after_a_failure(spark, tmp_path):
    """Two relays that send a part at each connection, cut within frames; a run fails between reading and commit, and nothing is lost or doubled."""
    frames = [bytes(r.frame) for r in ndtp.frames_of(fixtures.traffic(spark, SF).where("tr_id < 6")).select("frame").collect()]
    halves = [b"".join(frames[::2]), b"".join(frames[1::2])]

    def relay(data):
        server = socket.create_server(("127.0.0.1", 0))
        parts = [data[i : i + len(data) // 3 + 1] for i in range(0, len(data), len(data) // 3 + 1)]

        def serve():
            for part in parts:
                peer = server.accept()[0]
                peer.sendall(part)
                peer.close()
            server.close()

        threading.Thread(target=serve, daemon=True).start()
        return f"127.0.0.1:{server.getsockname()[1]}"

    at = [relay(h) for h in halves]
    spark.dataSource.register(TcpPositions)
    got, failed = {}, []

    def sink(batch, number):
        got[number] = sorted(map(tuple, batch.collect()))
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost between reading and commit")

    def run(until):
        stream = spark.readStream.format("ndtp-tcp").options(endpoints=",".join(at), log=f"file://{tmp_path}/log", wait=2).load()
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
        for _ in range(300):
            if not q.isActive or until():
                break
            threading.Event().wait(0.2)
        q.stop()

    run(lambda: False)
    assert failed
    first = got[1]
    total = len(frames)
    run(lambda: sum(map(len, got.values())) >= total and max(got) > 2)
    assert got[1] == first  # the batch that failed came again as it was
    want = sorted(map(tuple, ndtp.decode(fixtures_frames(spark, frames)).collect()))
    assert sorted(x for rows in got.values() for x in rows) == want and len(want) == total


def fixtures_frames(spark, frames):
    return spark.createDataFrame([(bytearray(f),) for f in frames], "frame binary")


def test_vehicle_state_expires(spark, tmp_path):
    """A vehicle whose time ran out at a batch without it starts anew; one that comes with the batch that passes its time goes on."""
    schema = "tr_id long, ts long, lat double, lon double, location_valid boolean"
    seen = []
    files = [[(1, t, 1.0, 1.0, True) for t in (10, 20, 30)], [(2, 100_000, 1.0, 1.0, True)], [(2, 200_000, 1.0, 1.0, True)], [(1, 200_001, 1.0, 1.0, True), (2, 200_002, 1.0, 1.0, True)]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("event_time", F.timestamp_seconds("ts"))
        state = vehicle_state(stream, "10 seconds", 3600)
        q = state.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(x[0], x[1], x[4]) for x in sorted(seen, key=lambda x: (x[1], x[0]))] == [(1, 30, 3), (2, 100_000, 1), (2, 200_000, 2), (1, 200_001, 1), (2, 200_002, 3)]


def test_ticks_with_a_loaded_model(spark, tmp_path):
    """A model that was saved and loaded scores the tick's features as it scores a batch's."""
    from tramline.operators import app, features, model

    f = fixtures.traffic(spark, SF)
    s = fixtures.schedule(spark, SF).withColumns({c: F.col(c) + 172_800 for c in ("plan_s", "fact_s")})
    p = priors.build_priors(s, P)
    now = f.agg(F.max("ts")).first()[0]
    points = app.active_vehicles(f, now, P).select(F.col("tr_id").alias("sample_id"), "tr_id", F.lit(now).cast("long").alias("t"), F.lit(None).cast("double").alias("cur_dev_s"))
    keep = P.windows[-1] + P.match_window
    table = features.full_table(points, f.where(F.col("ts") > now - keep), s, p, P).withColumn("y", F.col("horizon_s") / 60.0).cache()
    model.save(model.fit(table, ["horizon_s", "hour", "stop_lat"], "y", trees=3, depth=2), f"{tmp_path}/model")
    loaded = model.load(spark, f"{tmp_path}/model")
    want = {r.tr_id: r.pred_s for r in app.snapshot(model.score(loaded, table, P).withColumns({c: F.col(c).cast("long") for c in ("tr_id", "target_stop_id", "stops_left_in_trip")}), F.col("pred_s"), P).collect()}
    ticks = Ticks(s, p, P, lambda t: model.score(loaded, t, P), keep, f"{tmp_path}/ticks")
    ticks(f.select(*ticks.columns), 0)
    assert want and {r.tr_id: r.pred_s for r in ticks.published(0).collect()} == want
