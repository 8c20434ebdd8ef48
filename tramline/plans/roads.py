"""Registered queries on road graphs, frames, streams and the model."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import clean, features, graph, lattice, matching, model, places, priors, track
from tramline.plans.registry import query
from tramline.plans.telemetry import _base, _rounded, _sql
from tramline.profile import FIXTURE as P
from tramline.session import shared_dir
from tramline.sources import fixtures, ndtp
from tramline.streaming import positions, snapping

SIDE = 8
_NODES = f"""
nodes AS (SELECT 1000 + {SIDE} * i + j AS node_id, 55.745::DOUBLE + 0.0015::DOUBLE * i AS lat, 37.594::DOUBLE + 0.0020::DOUBLE * j AS lon, i, j FROM range({SIDE}) a(i), range({SIDE}) b(j)),
named AS (SELECT node_id, lat, lon, 'street_' || j AS name FROM nodes WHERE j % 2 = 0)"""
_METRES = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_EDGES = f"edges AS (SELECT a.node_id AS u, b.node_id AS v, {_METRES} AS length_m FROM nodes a JOIN nodes b ON (b.i = a.i AND b.j = a.j + 1) OR (b.i = a.i + 1 AND b.j = a.j))"
_FLAT = "sqrt(pow((p.lat - n.lat) * 111132.0::DOUBLE, 2) + pow((p.lon - n.lon) * 111320.0::DOUBLE * cos(radians(55.75::DOUBLE)), 2))"


def grid_elements(spark: SparkSession) -> DataFrame:
    """A road document of a grid: rows without names, every second column a street; one way's middle node is unknown."""
    cells = spark.range(SIDE).select(F.col("id").alias("i")).join(spark.range(SIDE).select(F.col("id").alias("j")))  # 64 cells
    node = 1000 + SIDE * F.col("i") + F.col("j")
    nodes = cells.select(F.lit("node").alias("type"), node.alias("id"), (F.lit(55.745) + 0.0015 * F.col("i")).alias("lat"), (F.lit(37.594) + 0.0020 * F.col("j")).alias("lon"), F.lit(None).cast("array<bigint>").alias("nodes"), F.lit(None).cast("map<string,string>").alias("tags"))
    null = F.lit(None).cast("double")
    steps = F.sequence(F.lit(0), F.lit(SIDE - 1))
    rows = spark.range(SIDE).withColumnRenamed("id", "w").select(
        F.lit("way").alias("type"), (F.col("w") + 1).alias("id"), null.alias("lat"), null.alias("lon"),
        F.concat(F.transform(steps, lambda j: 1000 + SIDE * F.col("w") + j), F.array(F.lit(99_999).cast("long"))).alias("nodes"), F.create_map(F.lit("highway"), F.lit("residential")).alias("tags"),
    )
    cols = spark.range(SIDE).withColumnRenamed("id", "w").select(
        F.lit("way").alias("type"), (F.col("w") + 101).alias("id"), null.alias("lat"), null.alias("lon"), F.transform(steps, lambda i: 1000 + SIDE * i + F.col("w")).alias("nodes"),
        F.when(F.col("w") % 2 == 0, F.create_map(F.lit("highway"), F.lit("primary"), F.lit("name"), F.concat(F.lit("street_"), F.col("w").cast("string")))).otherwise(F.create_map(F.lit("highway"), F.lit("primary"))).alias("tags"),
    )
    return nodes.unionByName(rows).unionByName(cols).unionByName(cols)


def _grid(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = grid_elements(spark)
    ways, nodes = graph.way_nodes(e.dropDuplicates(["type", "id"])), graph.nodes_of(e)
    return nodes, graph.edges_of(ways, nodes), ways


def _roads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the road document that grows with the orders."""
    e = fixtures.road_elements(spark, sf_dir)
    nodes = graph.nodes_of(e)
    return nodes, graph.edges_of(graph.way_nodes(e), nodes)


def _roads_sql(body: str, *ctes: str, limit: int = 0) -> str:
    return "WITH RECURSIVE " + ",\n".join([fixtures.SQL, fixtures.ROADS.replace("{limit}", str(limit)), *ctes]) + body


@query(_roads_sql(" SELECT u, v, round(length_m, 3) AS length_m FROM redge"))
def graph_edges_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_roads(spark, sf_dir)[1], 3, "length_m")


@query(_sql(f"SELECT p.event_id AS point_id, arg_min(n.node_id, round({_FLAT}, 6) * 10000 + n.node_id / 10000.0::DOUBLE) AS place_id, round(min({_FLAT}), 3) AS dist_m FROM traffic p, nodes n WHERE {_FLAT} <= 300 GROUP BY 1", _NODES))
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.traffic(spark, sf_dir).select(F.col("event_id").alias("point_id"), "lat", "lon")
    near = matching.nearest(f, _grid(spark)[0].withColumnRenamed("node_id", "place_id"), 55.75, 300.0)
    return near.select("point_id", "place_id", F.round("dist_m", 3).alias("dist_m"))


@query(_sql(f"SELECT p.event_id AS point_id, arg_min(n.name, round({_FLAT}, 6) * 10000 + n.node_id / 10000.0::DOUBLE) AS name, round(min({_FLAT}), 3) AS dist_m FROM traffic p, named n WHERE {_FLAT} <= 150 GROUP BY 1", _NODES))
def nearest_named_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, ways = _grid(spark)
    named = graph.named_nodes(ways).join(nodes, "node_id").withColumnRenamed("node_id", "place_id")
    f = fixtures.traffic(spark, sf_dir).select(F.col("event_id").alias("point_id"), "lat", "lon")
    return matching.nearest(f, named, 55.75, 150.0).join(named.select("place_id", "name"), "place_id").select("point_id", "name", F.round("dist_m", 3).alias("dist_m"))


@query(_sql(f"SELECT p.event_id AS point_id, count(*) AS n_near, round(max(d), 3) AS farthest_m FROM (SELECT p.event_id, {_FLAT} AS d, row_number() OVER (PARTITION BY p.event_id ORDER BY {_FLAT}, n.node_id) AS r FROM traffic p, nodes n WHERE {_FLAT} <= 400) p WHERE r <= 8 GROUP BY 1", _NODES))
def route_vertices_8nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.traffic(spark, sf_dir).select(F.col("event_id").alias("point_id"), "lat", "lon")
    near = matching.nearest(f, _grid(spark)[0].withColumnRenamed("node_id", "place_id"), 55.75, P.route_snap, k=8)
    return near.groupBy("point_id").agg(F.count("*").alias("n_near"), F.round(F.max("dist_m"), 3).alias("farthest_m"))


_TO_NODE = "sqrt(pow((p.lat - n.lat) * 111132.0::DOUBLE, 2) + pow((p.lon - n.lon) * 111320.0::DOUBLE * cos(radians(55.75::DOUBLE)), 2))"


@query(_sql(f" SELECT p.event_id AS point_id, arg_min(n.node_id, {_TO_NODE}) AS shape_id, round(round(min({_TO_NODE}), 6), 3) AS dist_m FROM traffic p, (SELECT DISTINCT o_custkey AS node_id, 55.0::DOUBLE + 0.0015::DOUBLE * (o_custkey // 40) + ((o_custkey * 7919) % 101 - 50) * 1e-6::DOUBLE AS lat, 37.0::DOUBLE + 0.002::DOUBLE * (o_custkey % 40) + ((o_custkey * 104729) % 103 - 51) * 1e-6::DOUBLE AS lon FROM orders) n GROUP BY 1"))
def nearest_node_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The road node nearest to each fix, however far."""
    f = fixtures.traffic(spark, sf_dir).select(F.col("event_id").alias("point_id"), "lat", "lon")
    nodes = graph.nodes_of(fixtures.road_elements(spark, sf_dir)).withColumnRenamed("node_id", "place_id")
    return _rounded(places.nearest_shape(f, places.points_as_shapes(nodes), 55.75).select("point_id", "shape_id", "dist_m"), 3, "dist_m")


_ALONG = """
leg AS (SELECT tr_id, row_number() OVER w - 1 AS shape_id, stop_lat * 111132.0::DOUBLE AS y0, stop_lon * 111320.0::DOUBLE * cos(radians(55.75::DOUBLE)) AS x0, lead(stop_lat) OVER w * 111132.0::DOUBLE AS y1, lead(stop_lon) OVER w * 111320.0::DOUBLE * cos(radians(55.75::DOUBLE)) AS x1
  FROM schedule WINDOW w AS (PARTITION BY tr_id ORDER BY plan_s, tt_action_item_id)),
seen AS (SELECT event_id, tr_id, lat * 111132.0::DOUBLE AS y, lon * 111320.0::DOUBLE * cos(radians(55.75::DOUBLE)) AS x FROM traffic WHERE location_valid),
shot AS (SELECT event_id, x, y, x0, y0, x1, y1, least(greatest(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / greatest(pow(x1 - x0, 2) + pow(y1 - y0, 2), 1e-9::DOUBLE), 0), 1) AS t FROM seen JOIN leg ON leg.tr_id = seen.tr_id WHERE x1 IS NOT NULL)"""


@query(_sql("SELECT event_id AS point_id, round(round(min(sqrt(pow(x0 + t * (x1 - x0) - x, 2) + pow(y0 + t * (y1 - y0) - y, 2))), 6), 3) AS dist_m FROM shot GROUP BY 1 HAVING min(sqrt(pow(x0 + t * (x1 - x0) - x, 2) + pow(y0 + t * (y1 - y0) - y, 2))) <= 600", _ALONG))
def route_line_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each fix is from the line through its vehicle's own stops, within 600 metres."""
    f = matching.valid_fixes(fixtures.traffic(spark, sf_dir)).select(F.col("event_id").alias("point_id"), "tr_id", "lat", "lon")
    stops = fixtures.schedule(spark, sf_dir).select("tr_id", "plan_s", "tt_action_item_id", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    route = places.lines(stops, "tr_id", ["plan_s", "tt_action_item_id"])
    return _rounded(places.nearest_shape(f, route, 55.75, "tr_id", 600.0).select("point_id", "dist_m"), 3, "dist_m")


@query(_sql(f"SELECT u, v, round(length_m, 3) AS length_m FROM edges WHERE u IN (SELECT node_id FROM close) AND v IN (SELECT node_id FROM close)", _NODES, _EDGES, f"close AS (SELECT DISTINCT n.node_id FROM traffic p, nodes n WHERE {_FLAT} <= 12)"))
def subgraph_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges between nodes that any fix comes within 12 metres of."""
    nodes, edges, _ = _grid(spark)
    return _rounded(graph.corridor(nodes, edges, fixtures.traffic(spark, sf_dir), 12.0, 55.75)[1], 3, "length_m")


@query(_sql("SELECT a.tr_id, u, v, round(length_m, 3) AS length_m FROM edges JOIN close a ON a.node_id = u JOIN close b ON b.node_id = v AND b.tr_id IS NOT DISTINCT FROM a.tr_id", _NODES, _EDGES, f"close AS (SELECT DISTINCT p.tr_id, n.node_id FROM traffic p, nodes n WHERE {_FLAT} <= 120)"))
def subgraph_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = _grid(spark)
    return _rounded(graph.corridors(nodes, edges, fixtures.traffic(spark, sf_dir), 120.0, 55.75), 3, "length_m")


@query(_roads_sql(" SELECT source, node, round(d, 3) AS dist_m FROM dist", limit=700))
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes within 700 metres of the first stop of each vehicle."""
    sources = fixtures.vehicle_ends(spark, sf_dir).select("source").distinct()
    return graph.shortest_paths(_roads(spark, sf_dir)[1], sources, limit_m=700.0).select("source", "node", F.round("dist_m", 3).alias("dist_m"))


_LINES = """
pairs AS (SELECT DISTINCT source, target FROM ends),
lines AS (SELECT p.source, p.target, d, CASE WHEN len(path) > 1 THEN path ELSE [[round(a.lon, 6), round(a.lat, 6)], [round(z.lon, 6), round(z.lat, 6)]] END AS vertices
  FROM pairs p JOIN rnode a ON a.node_id = p.source JOIN rnode z ON z.node_id = p.target LEFT JOIN dist b ON b.source = p.source AND b.node = p.target)
SELECT source, target, round(d, 3) AS dist_m, vertices, CAST(len(vertices) AS INT) AS n FROM lines"""


@query(_roads_sql("", _LINES, limit=1000))
def route_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from the first to the last stop of each vehicle, of a kilometre at most; straight lines for the others."""
    nodes, edges = _roads(spark, sf_dir)
    pairs = fixtures.vehicle_ends(spark, sf_dir).select("source", "target").distinct()
    known = graph.shortest_paths(edges, pairs.select("source"), limit_m=1000.0)
    return _rounded(graph.polylines(known, nodes, pairs), 3, "dist_m")


#: The rule of map matching, with the fixtures' times.
MATCH = lattice.Rule(apart=1_200, gap=72_000, wait=3_600, wait_most=72_000)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = _grid(spark)
    return lattice.match_segments(matching.valid_fixes(fixtures.traffic(spark, sf_dir)), nodes, edges, MATCH)


@query()
def hmm_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vehicle's fixes on the roads, with the nodes passed between them."""
    nodes, edges, _ = _grid(spark)
    return lattice.match_tracks(matching.valid_fixes(fixtures.traffic(spark, sf_dir)), nodes, edges, MATCH)


@query()
def hmm_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hmm_snap by a stream that is stopped in between; a fix of no vehicle, far later, lets the watermark pass all others."""
    nodes, edges, _ = _grid(spark)
    folder = f"{shared_dir(spark)}/snapping-{uuid.uuid4().hex}"
    f = matching.valid_fixes(fixtures.traffic(spark, sf_dir)).select("tr_id", "ts", "lat", "lon")
    cut = f.agg(F.percentile_approx("ts", 0.6)).first()[0] or 0
    end = spark.sql("SELECT -1L AS tr_id, 4102444800L AS ts, 0D AS lat, 0D AS lon")
    for part in (f.where(F.col("ts") <= cut), f.where(F.col("ts") > cut), end):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(f.schema).parquet(f"{folder}/in").withColumn("event_time", F.timestamp_seconds("ts"))
        live = snapping.match_stream(stream, nodes, edges, MATCH, "1 hour")
        live.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{folder}/out").where("settled").drop("settled", "seq")


@query()
def hmm_stop_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays of planned arrivals by passages along matched tracks."""
    return track.passage_delays(_segments(spark, sf_dir), fixtures.schedule(spark, sf_dir), P.match_radius, float(P.match_window))


@query()
def refined_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations at each point, with passages along matched tracks before fixes nearby."""
    f, s, p = _base(spark, sf_dir)
    return features.deviation_features(p, f, s, P, _segments(spark, sf_dir))


_STILL_S, _STILL_MPS = 900 * 120, 0.005
_STUCK = f"""
win AS (SELECT * FROM (SELECT tr_id, CAST(ts AS DOUBLE) AS ts, lat, lon, max(ts) OVER (PARTITION BY tr_id) AS last FROM traffic WHERE location_valid) WHERE ts >= last - {_STILL_S}),
step AS (SELECT *, coalesce(sqrt(pow((lat - lag(lat) OVER w) * 111132.0::DOUBLE, 2) + pow((lon - lag(lon) OVER w) * 111320.0::DOUBLE * cos(radians(55.75::DOUBLE)), 2)) / nullif(ts - lag(ts) OVER w, 0) < {_STILL_MPS}, false) AS low FROM win WINDOW w AS (PARTITION BY tr_id ORDER BY ts)),
run AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY tr_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM step),
still AS (SELECT tr_id, run, min(ts) AS since, max(ts) - min(ts) AS seconds, list({{'lat': lat, 'lon': lon}} ORDER BY ts)[count(*) // 2 + 1] AS mid FROM run GROUP BY 1, 2 HAVING max(ts) - min(ts) >= 120),
longest AS (SELECT *, mid.lat AS lat, mid.lon AS lon FROM still QUALIFY row_number() OVER (PARTITION BY tr_id ORDER BY seconds DESC, since) = 1),
street AS (SELECT p.tr_id, arg_min(n.name, round({_FLAT}, 6) * 10000 + n.node_id / 10000.0::DOUBLE) AS name FROM longest p, named n WHERE {_FLAT} <= 150 GROUP BY 1)"""


@query(_sql("SELECT l.tr_id, l.since, l.seconds, s.name FROM longest l LEFT JOIN street s ON s.tr_id = l.tr_id", _NODES, _STUCK))
def stuck_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each vehicle stood longest of late, and the named street there."""
    nodes, _, ways = _grid(spark)
    still = track.longest_stop(matching.valid_fixes(fixtures.traffic(spark, sf_dir)).withColumn("ts", F.col("ts").cast("double")), window_s=float(_STILL_S), slow=_STILL_MPS)
    named = graph.named_nodes(ways).join(nodes, "node_id").withColumnRenamed("node_id", "place_id")
    street = matching.nearest(still.select(F.col("tr_id").alias("point_id"), "lat", "lon"), named, 55.75, 150.0).join(named.select("place_id", "name"), "place_id")
    return still.join(street.select(F.col("point_id").alias("tr_id"), "name"), "tr_id", "left").select("tr_id", "since", "seconds", "name")


@query(_sql("SELECT unit_id, ts, CASE WHEN location_valid THEN 1 ELSE -1 END * floor(lat * 1e7::DOUBLE) / 1e7::DOUBLE AS lat, CASE WHEN location_valid THEN 1 ELSE -1 END * floor(lon * 1e7::DOUBLE) / 1e7::DOUBLE AS lon, location_valid, floor(speed) AS speed, heading, 150.0::DOUBLE AS altitude, CAST(9 AS INT) AS nsat FROM traffic"))
def ndtp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndtp.decode(ndtp.frames_of(fixtures.traffic(spark, sf_dir)))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as a stream of files takes no single file.
    raw = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    return raw.select("event_id", F.col("user_id").alias("tr_id"), F.col("ts").cast("timestamp").alias("event_time"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_type") != "error").alias("location_valid"), F.round(F.col("value") * 100).cast("long").alias("speed_c"), (F.lit(55.75) + (F.get_json_object("props", "$.k").cast("int") - 50) * F.lit(1e-4)).alias("lat"), (F.lit(37.6) + ((F.col("event_id") * 37) % 101 - 50) * F.lit(1e-4)).alias("lon"))


def _all_there_is(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a streaming query over what is there now; its result table, the last row of each key in update mode."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}-")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(f"{at}/out")
    if mode == "complete":
        return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")
    if not keys:
        return out.drop("batch")
    rest = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max(F.struct("batch", *(c for c in rest if c != "batch"))).alias("x")).select(*keys, *(f"x.{c}" for c in rest if c != "batch"))


@query(_sql("SELECT tr_id, ts - ts % 86400 AS start_s, count(*) AS n, CAST(sum(speed_c) AS BIGINT) AS speed_sum_c FROM traffic GROUP BY 1, 2"))
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_there_is(spark, positions.tumbling(_stream(spark, sf_dir), "1 day", "60 days"), "complete")


@query(_sql("SELECT tr_id, s AS start_s, count(*) AS n, CAST(sum(speed_c) AS BIGINT) AS speed_sum_c FROM (SELECT *, unnest([ts - ts % 43200, ts - ts % 43200 - 43200]) AS s FROM traffic) GROUP BY 1, 2"))
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_there_is(spark, positions.tumbling(_stream(spark, sf_dir), "1 day", "60 days", "12 hours"), "complete")


@query(_sql(f"SELECT tr_id, min(ts) AS start_s, max(ts) + {P.trip_gap} AS end_s, count(*) AS n FROM (SELECT *, sum(CASE WHEN g < {P.trip_gap} THEN 0 ELSE 1 END) OVER (PARTITION BY tr_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY tr_id ORDER BY ts, event_id) AS g FROM traffic)) GROUP BY tr_id, s"))
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A fix's time is its whole second, as everywhere; with fractions a pause of just the gap would not part two sessions.
    whole = _stream(spark, sf_dir).withColumn("event_time", F.timestamp_seconds("ts"))
    return _all_there_is(spark, positions.sessions(whole, f"{P.trip_gap} seconds", "60 days"), "complete")


@query(_sql("SELECT tr_id, max(ts) FILTER (location_valid) AS last_ts, arg_max(lat, ts) FILTER (location_valid) AS last_lat, arg_max(lon, ts) FILTER (location_valid) AS last_lon, count(*) AS total, count(*) FILTER (location_valid) AS valid FROM traffic GROUP BY 1"))
def stream_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = positions.vehicle_state(_stream(spark, sf_dir).select("tr_id", "ts", "event_time", "lat", "lon", "location_valid"), "60 days", 90 * 86400)
    return _all_there_is(spark, state, "update", ["tr_id"])


# Of what is there at once nothing is late; a day is given out when the mark, an hour behind the last fix, has passed its end.
@query(_sql("SELECT tr_id, ts - ts % 86400 AS start_s, count(*) AS n, CAST(sum(speed_c) AS BIGINT) AS speed_sum_c FROM traffic GROUP BY 1, 2 HAVING min(ts - ts % 86400) + 86400 <= (SELECT max(epoch(ts)) FROM events) - 3600"))
def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_there_is(spark, positions.tumbling(_stream(spark, sf_dir), "1 day", "1 hour"), "append")


@query(_sql("SELECT event_id, coalesce(m.tr_id, f.unit_id) AS tr_id, f.ts FROM traffic f LEFT JOIN (SELECT DISTINCT unit_id, tr_id FROM traffic WHERE tr_id % 3 <> 0) m ON m.unit_id = f.unit_id WHERE f.location_valid"))
def stream_static_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = clean.unit_map(fixtures.traffic(spark, sf_dir).where("tr_id % 3 <> 0"))
    s = _stream(spark, sf_dir).withColumn("unit_id", F.col("tr_id") + 1_000_000).where("location_valid").drop("tr_id")
    bound = s.join(units, "unit_id", "left").select("event_id", F.coalesce("tr_id", "unit_id").alias("tr_id"), "ts")
    return _all_there_is(spark, bound, "append")


_NUMBERS = [c for c in features.FEATURES if c not in model.CATEGORIES]


@query()
def ml_gbt_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s, p = _base(spark, sf_dir)
    known = s.where("tr_id % 3 <> 0")  # priors and the model see the facts of two thirds of the vehicles
    df = features.full_table(p, f, s.withColumn("target_delay_s", F.col("dev_s").cast("double")), priors.build_priors(known, P), P, also=("target_delay_s",))
    df = graph._saved(df)
    vehicle = F.col("tr_id").cast("long")
    fitted = model.fit(df.where(vehicle % 3 != 0), _NUMBERS, "target_delay_s", trees=5, depth=4, key="sample_id", validation=vehicle % 9 == 1)
    return model.score(fitted, df.where(vehicle % 3 == 0), P, key="sample_id").select("sample_id", "tr_id", "target_stop_id", "target_delay_s", "pred_s")


