"""Road graphs as DataFrames: nodes (node_id, lat, lon), edges (u, v, length_m), ways (way_id, name, pos, node_id)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import LAT_M, LON_M, haversine_m, planar_m
from tramline.operators.scan import saved


def way_nodes(elements: DataFrame) -> DataFrame:
    """The nodes of each way in order; nodes without coordinates are left out before neighbours are formed."""
    nodes = nodes_of(elements)
    ways = elements.where("type = 'way'").select(F.col("id").alias("way_id"), F.col("tags")["name"].alias("name"), F.posexplode("nodes").alias("pos", "node_id"))
    return ways.join(nodes.select("node_id"), "node_id", "left_semi")


def nodes_of(elements: DataFrame) -> DataFrame:
    return elements.where("type = 'node' AND lat IS NOT NULL AND lon IS NOT NULL").select(F.col("id").alias("node_id"), "lat", "lon").dropDuplicates(["node_id"])


def directed_pairs(ways: DataFrame) -> DataFrame:
    """Distinct neighbours (u, v) along the ways, in the ways' direction."""
    after = F.lead("node_id").over(Window.partitionBy("way_id").orderBy("pos"))
    return ways.withColumn("v", after).where("v IS NOT NULL AND v <> node_id").select(F.col("node_id").alias("u"), "v").distinct()


def edges_of(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected edges u < v with the least length of their parallels, in metres on the sphere."""
    pairs = directed_pairs(ways)
    a = nodes.select(F.col("node_id").alias("u"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    both = pairs.join(a, "u").join(b, "v").withColumn("length_m", haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    return both.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("length_m").alias("length_m"))


def named_nodes(ways: DataFrame) -> DataFrame:
    """The name of the first named way through each node."""
    return ways.where("name IS NOT NULL AND name <> ''").groupBy("node_id").agg(F.min(F.struct("way_id", "name")).alias("x")).select("node_id", F.col("x.name").alias("name"))


def corridor(nodes: DataFrame, edges: DataFrame, track: DataFrame, pad_m: float, lat0: float) -> tuple[DataFrame, DataFrame]:
    """Nodes within pad_m of any track point, by grid cells, and the edges with both ends among them."""
    lon_m = LON_M * math.cos(math.radians(lat0))
    cell = lambda c, m: F.floor(F.col(c) * m / pad_m)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    asked = track.select(F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), around.alias("o")).select(
        "tlat", "tlon", (cell("tlat", LAT_M) + F.col("o.i")).alias("ci"), (cell("tlon", lon_m) + F.col("o.j")).alias("cj")
    )
    placed = nodes.withColumns({"ci": cell("lat", LAT_M), "cj": cell("lon", lon_m)})
    close = placed.join(
        asked, (placed.ci == asked.ci) & (placed.cj == asked.cj) & (planar_m(placed.lat, placed.lon, asked.tlat, asked.tlon, F.lit(lat0)) <= pad_m), "left_semi"
    ).drop("ci", "cj")
    inside = edges.join(close.select(F.col("node_id").alias("u")), "u", "left_semi").join(close.select(F.col("node_id").alias("v")), "v", "left_semi")
    return close, inside.select("u", "v", "length_m")


def corridors(nodes: DataFrame, edges: DataFrame, track: DataFrame, pad_m: float, lat0: float) -> DataFrame:
    """corridor()'s edges for each vehicle by its own points: tr_id, u, v, length_m; the nodes are spread over the cells around them."""
    lon_m = LON_M * math.cos(math.radians(lat0))
    cell = lambda c, m: F.floor(F.col(c) * m / pad_m)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    placed = nodes.select("node_id", "lat", "lon", around.alias("o"), cell("lat", LAT_M).alias("i"), cell("lon", lon_m).alias("j")).select(
        "node_id", "lat", "lon", (F.col("i") + F.col("o.i")).alias("ci"), (F.col("j") + F.col("o.j")).alias("cj")
    )
    asked = track.select("tr_id", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), cell("lat", LAT_M).alias("ci"), cell("lon", lon_m).alias("cj"))
    near = planar_m(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon"), F.lit(lat0)) <= pad_m
    close = asked.join(placed, ["ci", "cj"]).where(near).select("tr_id", "node_id").distinct()
    begun = close.withColumnRenamed("node_id", "u").join(edges, "u").select(F.col("tr_id").alias("b_tr"), "u", "v", "length_m")
    ends = (F.col("v") == F.col("node_id")) & F.col("b_tr").eqNullSafe(F.col("tr_id"))
    return begun.join(close, ends, "left_semi").select(F.col("b_tr").alias("tr_id"), "u", "v", "length_m")


_saved = saved


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys and sorted, once: rounds bring what they ask for to its rows, which stay where they are."""
    return _spread(df, *keys).sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY)


def shortest_paths(edges: DataFrame, sources: DataFrame, limit_m: float = math.inf, delta_m: float | None = None, rounds: int = 100_000) -> DataFrame:
    """Distance and predecessor of every node within limit_m of each source (column source), by delta-stepping.

    Returns (source, node, dist_m, prev); of equal distances the smaller
    predecessor is kept.  Distances go in steps of delta_m (by default eight of the
    longest edges).  Within a step the nodes that came closer are expanded until
    none does; then all that lies in it is final and is written, once.  A way to a
    node that is final comes from within the longest edge of it, so what is
    expanded is compared with the last steps' nodes only: a round joins and
    shuffles the rim of what is known, not the whole, and no edges.  Edges longer
    than limit_m are on no way.  Edges u-v are walked both
    ways; their lengths aren't negative.  Raises an error if nodes are left to
    expand after `rounds` rounds: what is known then need not be whole or final.
    """
    both = edges.select("u", "v", "length_m").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length_m"))
    both = saved(both.where("u <> v").where(F.col("length_m") <= limit_m).groupBy("u", "v").agg(F.min("length_m").alias("length_m")))
    both = _dealt(both, "u")
    longest = both.agg(F.max("length_m")).first()[0] or 0.0
    step = delta_m or max(8 * longest, 1e-6)
    columns = ["source", "node", "dist_m", "prev"]
    # open: reached and not final; changed: not expanded since it came closer.  rim: final and within reach of what comes.
    open_ = saved(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist_m"), F.lit(None).cast("long").alias("prev"), F.lit(True).alias("changed")).where("source IS NOT NULL").distinct())
    rim, done = open_.select(*columns).limit(0), []
    for _ in range(rounds):
        nearest = open_.agg(F.min("dist_m")).first()[0]
        if nearest is None:
            break
        end = (math.floor(nearest / step) + 1) * step
        while True:
            front = open_.where(F.col("changed") & (F.col("dist_m") < end))
            if front.isEmpty():
                break
            reached = front.join(both, front["node"] == both["u"]).select("source", F.col("v").alias("node"), (F.col("dist_m") + F.col("length_m")).alias("dist_m"), F.col("u").alias("prev")).where(F.col("dist_m") <= limit_m)
            reached = reached.withColumns({"changed": F.lit(True), "final": F.lit(False)})
            expanded = open_.withColumns({"changed": F.col("changed") & (F.col("dist_m") >= end), "final": F.lit(False)})
            known = rim.withColumns({"changed": F.lit(False), "final": F.lit(True)})
            # Narrow rows go to their node, once.  Of a node that is known at the same distance nothing changes, and it isn't expanded again.
            met = _spread(expanded.unionByName(reached).unionByName(known), "source", "node").groupBy("source", "node")
            best = met.agg(F.min(F.struct("dist_m", "changed", "prev")).alias("x"), F.min(F.struct("dist_m", F.coalesce("prev", F.lit(-(2**63))).alias("p"))).alias("y"), F.max("final").alias("final")).where("NOT final")
            open_ = saved(best.select("source", "node", "x.dist_m", F.when(F.col("y.p") != -(2**63), F.col("y.p")).alias("prev"), "x.changed"))
        final = open_.where(F.col("dist_m") < end).select(*columns)
        done.append(final)
        rim = saved(rim.unionByName(final).where(F.col("dist_m") >= end - longest - 1e-6))
        open_ = saved(open_.where(F.col("dist_m") >= end))
    else:
        if not open_.isEmpty():
            raise ValueError(f"nodes are left to expand after {rounds} rounds; allow more")
    both.unpersist()
    return reduce(DataFrame.unionByName, done) if done else open_.select(*columns)


def polylines(paths: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The vertices of the way from source to target of each pair, in order: source, target, n, vertices, dist_m.

    Predecessors are followed one step a round for all pairs together; only the
    pairs are shuffled, not the paths.  A pair
    without a way gets the straight line between its ends, and dist_m null; one
    whose ends are the same node gets the node twice.
    """
    back = _dealt(paths.select("source", "node", "prev", "dist_m"), "source", "node")
    at = pairs.select("source", "target").distinct().join(back.withColumnRenamed("node", "target"), ["source", "target"], "left").withColumns({"node": F.col("target"), "path": F.array("target")})
    at = _saved(at)
    done, live = [at.where("prev IS NULL")], at.where("prev IS NOT NULL")
    while True:
        live = _saved(live.withColumns({"node": F.col("prev"), "path": F.concat(F.array("prev"), "path")}).drop("prev").join(back.select("source", "node", "prev"), ["source", "node"]).select(*at.columns))
        done.append(live.where("prev IS NULL"))
        live = live.where("prev IS NOT NULL")
        if live.isEmpty():
            break
    back.unpersist()
    whole = reduce(DataFrame.unionByName, done).withColumn("path", F.when(F.size("path") > 1, F.col("path")).otherwise(F.array("source", "target")))
    placed = whole.select("source", "target", "dist_m", F.posexplode("path").alias("pos", "node_id")).join(nodes, "node_id")
    last = Window.partitionBy("source", "target").orderBy("pos")
    same = (F.lag("node_id").over(last) == F.col("node_id")) & (F.col("source") != F.col("target"))
    kept = placed.withColumn("same", F.coalesce(same, F.lit(False))).where("NOT same")
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda x: F.array(F.round(x["lon"], 6), F.round(x["lat"], 6)))
    return kept.groupBy("source", "target", "dist_m").agg(line.alias("vertices")).withColumn("n", F.size("vertices"))
