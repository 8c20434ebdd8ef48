"""Telemetry, schedule and prediction points made from the driver's events and orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.geo import stop_key
from tramline.functions.scalars import epoch_s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position fix per event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id",
        F.col("user_id").alias("tr_id"),
        (F.col("user_id") + 1_000_000).alias("unit_id"),
        epoch_s(F.col("ts")).alias("ts"),
        (F.col("event_type") != "error").alias("location_valid"),
        (F.lit(55.75) + (k - 50) * F.lit(1e-4)).alias("lat"),
        (F.lit(37.6) + ((F.col("event_id") * 37) % 101 - 50) * F.lit(1e-4)).alias("lon"),
        F.col("value").alias("speed"),
        F.round(F.col("value") * 100).cast("long").alias("speed_c"),
        ((F.col("event_id") * 53) % 360).cast("double").alias("heading"),
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One planned arrival per order, with the fact where it is known."""
    o = table(spark, sf_dir, "orders")
    place = lambda m: (((F.col("o_custkey") * m) % 40) * F.lit(2.5) - 50) * F.lit(1e-4)
    s = o.select(
        F.col("o_orderkey").alias("tt_action_item_id"),
        F.expr("o_custkey div 10").alias("tr_id"),
        (F.lit(1704067200) + (F.col("o_orderkey") * 7919 * 13) % 2592000).cast("long").alias("plan_s"),
        (F.round(F.col("o_totalprice") * 100).cast("long") % 3001 - 1500).alias("dev_s"),
        (F.lit(55.75) + place(7)).alias("stop_lat"),
        (F.lit(37.6) + place(11)).alias("stop_lon"),
    )
    return s.withColumns({"fact_s": F.col("plan_s") + F.col("dev_s"), "stop_key": stop_key(F.col("stop_lat"), F.col("stop_lon"))})


def points(traffic: DataFrame) -> DataFrame:
    """A prediction point at each fix."""
    return traffic.select(
        F.col("event_id").alias("sample_id"), "tr_id", F.col("ts").alias("t"), ((F.col("event_id") * 17) % 601 - 300).cast("double").alias("cur_dev_s")
    )


def road_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A road document that grows with the orders: a node per customer, a way per vehicle and day along its planned arrivals,
    and named streets from each customer to the one forty on."""
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_custkey").alias("id")).distinct()
    null = F.lit(None).cast("double")
    nodes = c.select(
        F.lit("node").alias("type"), "id", (F.lit(55.0) + F.lit(0.0015) * F.expr("id div 40") + ((F.col("id") * 7919) % 101 - 50) * F.lit(1e-6)).alias("lat"),
        (F.lit(37.0) + F.lit(0.002) * (F.col("id") % 40) + ((F.col("id") * 104_729) % 103 - 51) * F.lit(1e-6)).alias("lon"), F.lit(None).cast("array<bigint>").alias("nodes"), F.lit(None).cast("map<string,string>").alias("tags"),
    )
    s = schedule(spark, sf_dir).join(o.select(F.col("o_orderkey").alias("tt_action_item_id"), "o_custkey"), "tt_action_item_id")
    day = F.floor(F.col("plan_s") / 86_400)
    driven = s.groupBy((F.col("tr_id") * 100_000 + day).alias("id")).agg(F.array_sort(F.collect_list(F.struct("plan_s", "tt_action_item_id", "o_custkey"))).alias("stops"))  # a vehicle's day
    driven = driven.select(F.lit("way").alias("type"), "id", null.alias("lat"), null.alias("lon"), F.transform("stops", lambda x: x["o_custkey"]).alias("nodes"), F.create_map(F.lit("highway"), F.lit("residential")).alias("tags"))
    streets = c.select(
        F.lit("way").alias("type"), (-F.col("id") - 1).alias("id"), null.alias("lat"), null.alias("lon"), F.array(F.col("id"), F.col("id") + 40).alias("nodes"),
        F.create_map(F.lit("highway"), F.lit("primary"), F.lit("name"), F.concat(F.lit("street_"), (F.col("id") % 40).cast("string"))).alias("tags"),
    )
    return nodes.unionByName(driven).unionByName(streets)


def vehicle_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each vehicle's first and last planned arrival: tr_id, source, target."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tt_action_item_id"), "o_custkey")
    s = schedule(spark, sf_dir).join(o, "tt_action_item_id")
    at = F.struct("plan_s", "tt_action_item_id")
    return s.groupBy("tr_id").agg(F.min_by("o_custkey", at).alias("source"), F.max_by("o_custkey", at).alias("target"))


#: The road document's graph and the vehicles' ends for DuckDB, after SQL.
ROADS = """
cust AS (SELECT DISTINCT o_custkey AS id FROM orders),
rnode AS (SELECT id AS node_id, 55.0::DOUBLE + 0.0015::DOUBLE * (id // 40) + ((id * 7919) % 101 - 50) * 1e-6::DOUBLE AS lat, 37.0::DOUBLE + 0.002::DOUBLE * (id % 40) + ((id * 104729) % 103 - 51) * 1e-6::DOUBLE AS lon FROM cust),
stops AS (SELECT s.tr_id, s.plan_s, s.tt_action_item_id, o_custkey FROM schedule s JOIN orders ON o_orderkey = s.tt_action_item_id),
hops AS (SELECT o_custkey AS a, lead(o_custkey) OVER (PARTITION BY tr_id, plan_s // 86400 ORDER BY plan_s, tt_action_item_id) AS b FROM stops UNION ALL SELECT c.id, d.id FROM cust c JOIN cust d ON d.id = c.id + 40),
redge AS (SELECT u, v, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS length_m
  FROM (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM hops WHERE a <> b) JOIN rnode a ON a.node_id = u JOIN rnode b ON b.node_id = v),
rboth AS (SELECT u, v, length_m FROM redge UNION ALL SELECT v, u, length_m FROM redge),
ends AS (SELECT DISTINCT tr_id, first_value(o_custkey) OVER w AS source, last_value(o_custkey) OVER w AS target FROM stops WINDOW w AS (PARTITION BY tr_id ORDER BY plan_s, tt_action_item_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
dist(source, node, d, path) USING KEY (source, node) AS (
  SELECT source, source, 0.0::DOUBLE, [[round(lon, 6), round(lat, 6)]] FROM (SELECT DISTINCT source FROM ends) JOIN rnode ON node_id = source
  UNION
  SELECT x.source, e.v, min(x.d + e.length_m), arg_min(list_append(x.path, [round(n.lon, 6), round(n.lat, 6)]), x.d + e.length_m) FROM dist x JOIN rboth e ON e.u = x.node JOIN rnode n ON n.node_id = e.v LEFT JOIN recurring.dist r ON r.source = x.source AND r.node = e.v
  WHERE x.d + e.length_m <= {limit} AND (r.d IS NULL OR x.d + e.length_m < r.d) GROUP BY 1, 2)"""

#: The same three relations for DuckDB, as common table expressions.
SQL = """
traffic AS (
  SELECT event_id, user_id AS tr_id, user_id + 1000000 AS unit_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
         event_type <> 'error' AS location_valid,
         55.75::DOUBLE + (CAST(json_extract_string(props, '$.k') AS INT) - 50) * 1e-4::DOUBLE AS lat,
         37.6::DOUBLE + ((event_id * 37) % 101 - 50) * 1e-4::DOUBLE AS lon,
         value AS speed, CAST(round(value * 100) AS BIGINT) AS speed_c, CAST((event_id * 53) % 360 AS DOUBLE) AS heading
  FROM events),
schedule0 AS (
  SELECT o_orderkey AS tt_action_item_id, o_custkey // 10 AS tr_id,
         CAST(1704067200 + (o_orderkey * 7919 * 13) % 2592000 AS BIGINT) AS plan_s,
         CAST(round(o_totalprice * 100) AS BIGINT) % 3001 - 1500 AS dev_s,
         55.75::DOUBLE + (((o_custkey * 7) % 40) * 2.5::DOUBLE - 50) * 1e-4::DOUBLE AS stop_lat,
         37.6::DOUBLE + (((o_custkey * 11) % 40) * 2.5::DOUBLE - 50) * 1e-4::DOUBLE AS stop_lon
  FROM orders),
schedule AS (
  SELECT *, plan_s + dev_s AS fact_s, format('{:.5f}_{:.5f}', stop_lat, stop_lon) AS stop_key FROM schedule0),
points AS (
  SELECT event_id AS sample_id, tr_id, ts AS t, CAST((event_id * 17) % 601 - 300 AS DOUBLE) AS cur_dev_s FROM traffic)
"""
