"""What the third round found: joins that miss their key, ids that meet, work that outgrows its input."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.oracle import TABLES, same
from tramline.llm import quality_model, toxicity
from tramline.operators import app, features, graph, lattice, model, scan, track
from tramline.plans import catalogue, roundtrips, telemetry
from tramline.profile import FIXTURE as P
from tramline.sources import fixtures
from tramline.streaming import snapping

SF = "/root/testdata/sf0.001"


def _tables(tmp_path, **own) -> str:
    """A folder with the smallest tables, some of them replaced."""
    for t in TABLES:
        if t in own:
            pq.write_table(own[t], tmp_path / f"{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def _events(rows: list[tuple]) -> pa.Table:
    kinds = {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64(), "props": pa.string()}
    return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())})


def test_lateral_meets_only_its_buckets(spark):
    plan = catalogue.QUERIES["target_stop_lateral"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # no sort of all stops of a vehicle for each point
    assert all("b#" in line for line in plan.splitlines() if "HashJoin" in line or "SortMergeJoin" in line)


def test_two_points_in_one_second_are_apart(spark):
    labels = spark.createDataFrame([(1, 7, 100, 9, 0.0, 10), (2, 7, 100, 9, 0.0, 20)], "sample_id long, tr_id long, t long, target_stop_id long, cur_dev_s double, target_delay_s long")
    said = spark.createDataFrame([(2, 9, 30.0)], "sample_id long, target_stop_id long, pred_s double")
    r = app.evaluation(said, labels, ("sample_id",)).first()
    assert (r.labels, r.no_prediction, r.scored, r.mae_pred) == (2, 1, 1, 10.0)


def test_evaluation_with_points_of_one_second(spark, tmp_path):
    e = pq.read_table(f"{SF}/events.parquet").to_pylist()
    rows = [tuple(r.values()) for r in e]
    rows += [(100_000 + r[0] * 5, *r[1:]) for r in rows[:200]]  # the same seconds again, without a prediction
    same(spark, _tables(tmp_path, events=_events(rows)), catalogue.QUERIES["eval_mae_baselines"], catalogue.ORACLES["eval_mae_baselines"])


def test_session_gap_in_whole_seconds(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, at(s), 1, "view", 1.0, '{"k": 5}') for i, s in enumerate((0.9, 108_000.2, 216_000.0))]
    same(spark, _tables(tmp_path, events=_events(rows)), catalogue.QUERIES["stream_session"], catalogue.ORACLES["stream_session"])


def test_ids_of_foot_paths_are_their_own(spark, tmp_path):
    """Vehicle 10000 on day 19723 had the id of customer 19723's foot path."""
    o = pq.read_table(f"{SF}/orders.parquet")
    some = o.slice(0, 4)
    keys = {"o_orderkey": [0, 26, 1, 2], "o_custkey": [100_000, 100_001, 19_723, 19_764]}
    small = pa.table({c: pa.array(keys[c], o.schema.field(c).type) if c in keys else some.column(c) for c in o.column_names})
    d = _tables(tmp_path, orders=small)
    e = fixtures.road_elements(spark, d)
    ids = [r.id for r in e.unionByName(roundtrips.foot_paths(e)).where("type = 'way'").collect()]
    assert len(ids) == len(set(ids))
    same(spark, d, catalogue.QUERIES["roads_document"], catalogue.ORACLES["roads_document"])


def test_board_asks_for_one_point_a_vehicle(spark, monkeypatch):
    asked, whole = [], features.full_table

    def counted(points, *rest, **more):
        asked.append((points.count(), points.select("tr_id").distinct().count()))
        return whole(points, *rest, **more)

    monkeypatch.setattr(features, "full_table", counted)
    assert telemetry._board(spark, SF).count() == asked[0][0] == asked[0][1]


def test_fixes_of_one_place_share_their_net(monkeypatch):
    """A net was built, and its ways searched, for each fix anew."""
    rule, built = lattice.Rule(), []
    whole = lattice.Net
    monkeypatch.setattr(lattice, "Net", lambda edges: built.append(1) or whole(edges))
    here = lattice._edges([{"u": i, "v": i + 1, "ulat": 55.75, "ulon": 37.6 + i * 1e-3, "vlat": 55.75, "vlon": 37.601 + i * 1e-3} for i in range(5)], rule)
    nets, rows = lattice.Nets(), []
    for v in range(3):
        one = lattice.Lattice(rule, nets=nets)
        for k in range(20):
            rows += one.push(20 * k, 55.7501, 37.6 + 1e-4 * (k + v), here)
        rows += one.finish()
    assert len(rows) == 60 and len(built) == 1


def test_refined_features_match_tracks_once(spark):
    """What is read has no matching left in it, so it isn't done anew for each use."""
    plan = catalogue.QUERIES["refined_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_three_passes_take_short_keys_whole(spark, monkeypatch):
    """A key of few rows is one group, not one for each of its days; both ways give the same."""
    f = fixtures.traffic(spark, SF).select("event_id", "tr_id", "ts", "speed")
    found = {}
    for most in (scan.WHOLE, 0):
        monkeypatch.setattr(scan, "WHOLE", most)
        made = scan.three_passes(
            f, "tr_id", "ts", 86_400, lambda t: pa.table({"tr_id": t.column("tr_id").slice(0, 1), "_b": t.column("_b").slice(0, 1), "n": [len(t)]}), "n long", lambda t: t.select(["tr_id", "_b", "n"]), "n long",
            lambda t: pa.table({"b": t.column("_b").slice(0, 1), "n": t.column("n").slice(0, 1)}), "b long, n long",
        )
        groups = made.count()
        assert (groups == f.select("tr_id").distinct().count()) == (most > 0)
        found[most] = sorted(map(tuple, track.smoothed(f, "tr_id", "ts", "speed", 0.0, 300.0).select("event_id", "smooth").collect()))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(*found.values(), strict=True))


def test_model_encodings_carry_no_numbers(spark, monkeypatch):
    """The model's numbers went through the windows of each category's encoding."""
    rows = [(i, i % 7, i % 5, f"k{i % 3}", float(i % 11), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, tr_id long, target_stop_id long, stop_key string, speed double, y double")
    seen, whole = [], model.ordered_encode
    monkeypatch.setattr(model, "ordered_encode", lambda d, *a: seen.append(set(d.columns)) or whole(d, *a))
    fitted = model.fit(df, ["speed"], "y", trees=2, depth=2, key="sample_id", validation=F.col("tr_id") == 1)
    assert len(seen) == 3 and not any("speed" in c or "n_speed" in c for c in seen)
    assert model.score(fitted, df, P).count() == 60


def test_waiting_fixes_hold_no_roads(spark, tmp_path):
    """Each waiting fix had all roads around it in the state; now a vehicle holds those of a cell once."""
    schema = "tr_id long, ts long, lat double, lon double"
    spark.createDataFrame([(1, 20 * k, 55.7501, 37.6 + 1e-6 * k) for k in range(300)], schema).write.parquet(f"{tmp_path}/in")
    nodes = spark.createDataFrame([(i, 55.75, 37.6 + 5e-5 * i) for i in range(60)], "node_id long, lat double, lon double")
    edges = spark.createDataFrame([(i, i + 1) for i in range(59)], "u long, v long")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("event_time", F.timestamp_seconds("ts"))
    live = snapping.match_stream(stream, nodes, edges, late="5 days")
    q = live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < max(o.memoryUsedBytes for x in q.recentProgress for o in x.stateOperators) < 300_000


@pytest.mark.parametrize("query", ["target_stop", "target_stop_asof", "src_points_csv"])
def test_target_stops_of_far_ids(spark, tmp_path, query):
    """The SQL's order is not that of the plans alone where a vehicle's ids lie more than 100,000 apart."""
    o = pq.read_table(f"{SF}/orders.parquet")
    keys = pa.array([k * 300_000_007 % 9_000_000_011 for k in o.column("o_orderkey").to_pylist()], o.schema.field("o_orderkey").type)
    d = _tables(tmp_path, orders=o.set_column(o.column_names.index("o_orderkey"), "o_orderkey", keys))
    same(spark, d, catalogue.QUERIES[query], catalogue.ORACLES[query])


def test_quality_model_takes_all_labels(spark, monkeypatch):
    """Beyond 20,000 labelled rows the model was fitted on a sample."""
    kept, whole = [], quality_model.Scratch.keep
    monkeypatch.setattr(quality_model.Scratch, "keep", lambda self, df: kept.append(whole(self, df)) or kept[-1])
    docs = spark.range(0, 21_000, 1, 4).selectExpr("id AS doc_id", "'a b' AS text")
    quality_model.fit(docs, docs.selectExpr("doc_id", "1 AS quality"))
    assert kept[0].count() == 21_000
    scores = spark.range(0, 5_000, 1, 4).selectExpr("cast(pmod(xxhash64(id), 1000) AS double) / 7 AS s")
    for share in (0.0, 0.31, 0.5, 0.977, 1.0):
        assert quality_model._quantile(scores, share, 5_000) == pytest.approx(scores.agg(F.percentile("s", F.lit(share))).first()[0], abs=1e-9)


def test_quality_model_shuffles_no_text(spark, monkeypatch):
    """Texts went to their labels, and small tables by another join than large ones."""
    plans, whole = [], quality_model.Scratch.keep
    monkeypatch.setattr(quality_model.Scratch, "keep", lambda self, df: plans.append(df._jdf.queryExecution()) or whole(self, df))
    docs = spark.range(0, 40, 1, 4).selectExpr("id AS doc_id", "repeat(concat('a', id, ' '), 3) AS text")
    quality_model.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality"), rounds=2)
    assert len(plans) == 2
    for p in plans:
        assert "SortMergeJoin" in p.executedPlan().toString() and "BroadcastHashJoin" not in p.executedPlan().toString()
    joined = plans[0].optimizedPlan().toString().split("MapInArrow")[0]
    assert "Join" in joined and "text" not in joined


def test_toxicity_takes_all_labels(spark, monkeypatch):
    """Beyond 12,000 labelled rows the model and its thresholds came from a sample."""
    kept, whole = [], toxicity.Scratch.keep
    monkeypatch.setattr(toxicity.Scratch, "keep", lambda self, df: kept.append(whole(self, df)) or kept[-1])
    monkeypatch.setattr(toxicity.Scratch, "drop", lambda self, *tables: None)
    docs = spark.range(0, 14_000, 1, 4).selectExpr("id AS doc_id", "concat(if(id % 2 = 1, 'vile ', 'kind '), id) AS text")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic"), rounds=1, part_rows=2_000)
    chosen, rows, _, seen = kept
    assert chosen.count() == 14_000 == rows.count() + seen.count()
    assert rows.select("part").distinct().count() == 6
    assert model.score(docs).where("predicted <> doc_id % 2").count() == 0


def test_toxicity_averages_copies(spark):
    """Copies are averaged in pieces, as whole nets would be."""
    nets = [toxicity.Net.new(k) for k in range(3)]
    whole = np.mean(np.stack([n.flat() for n in nets]), axis=0)
    rows = [(i, k, x.tobytes()) for k, n in enumerate(nets) for i, x in enumerate(np.array_split(n.flat(), 5))]
    got = spark.createDataFrame(rows, "piece int, part int, numbers binary").groupBy("piece").applyInArrow(toxicity._mean, "piece int, numbers binary").collect()
    net = toxicity.Net.of(np.concatenate([np.frombuffer(x, np.float32) for _, x in sorted(map(tuple, got))]))
    assert np.allclose(net.flat(), whole, atol=1e-6) and [p.shape for p in net.arrays()] == [p.shape for p in nets[0].arrays()]


def test_toxicity_thresholds(spark):
    """Thresholds by windows are those of all rows in one array."""
    r = np.random.default_rng(4)
    for n, weight in ((1, 1.0), (40, 1.0), (700, 2.5)):
        logit, y, lang = np.round(r.normal(0, 3, n), 2) * np.where(r.random(n) < 0.02, 20, 1), r.integers(0, 2, n), r.integers(-1, 4, n)
        seen = spark.createDataFrame(list(zip(y.tolist(), logit.tolist(), lang.tolist(), strict=True)), "y int, logit double, language int")
        want = {-1: toxicity.threshold(logit, y, weight)}
        for k in range(4):
            own = lang == k
            if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= 5:
                want[k] = toxicity.threshold(logit[own], y[own], weight)
        assert toxicity.thresholds(seen, weight, 5) == pytest.approx(want, abs=1e-9)
    assert toxicity.thresholds(seen.limit(0), 1.0, 5) == {}


def _exchanges(df) -> int:
    """Shuffles that a plan makes itself, not those by which a kept table was dealt."""
    count, inside = 0, None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth > inside:
            continue
        inside = depth if "InMemoryRelation" in line else None
        count += "Exchange hashpartitioning" in line
    return count


def test_rounds_on_graphs_shuffle_no_edges(spark, monkeypatch):
    """Each round shuffled all edges and, along the predecessors, all paths."""
    counts = []
    for name in ("saved", "_saved"):
        whole = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda df, name=name, whole=whole: counts.append((name, _exchanges(df))) or whole(df))
    edges = spark.createDataFrame([(i, i + 1, 10.0) for i in range(6)] + [(0, 6, 500.0)], "u long, v long, length_m double")
    nodes = spark.createDataFrame([(i, 55.0, 37.0 + i) for i in range(7)], "node_id long, lat double, lon double")
    pairs = spark.createDataFrame([(0, 4), (2, 6), (0, 6)], "source long, target long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paths = graph.shortest_paths(edges, pairs.select("source").distinct(), limit_m=100.0)
        assert {(r.source, r.node): r.dist_m for r in paths.collect()} == {(s, n): 10.0 * abs(s - n) for s in (0, 2) for n in range(7)}
        rounds = [n for name, n in counts if name == "saved"][2:]  # after the edges and the sources
        assert len(rounds) > 5 and max(rounds) == 2
        counts.clear()
        lines = {(r.source, r.target): r.n for r in graph.polylines(paths, nodes, pairs).collect()}
        assert lines == {(0, 4): 5, (2, 6): 5, (0, 6): 7}
        assert len(counts) > 5 and max(n for _, n in counts[1:]) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
