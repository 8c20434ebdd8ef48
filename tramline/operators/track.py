"""Tracks within a vehicle: islands of low speed, decimation, map matching on a road graph.

Map matching follows Newson and Krumm (2009): nearby edges are the states of a
hidden Markov model, their distance from the fix gives the emission, the
difference of route and straight distance the transition.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import LAT_M, LON_M, planar_m
from tramline.operators.scan import saved, three_passes

SNAPPED = "tr_id long, ts double, lat double, lon double, raw_lat double, raw_lon double"


def _recent(track: DataFrame, window_s: float) -> DataFrame:
    """Each vehicle's last window_s seconds; the end comes from an aggregation, as a window would gather whole histories."""
    ends = track.groupBy(F.col("tr_id").alias("_e")).agg(F.max("ts").alias("_end"))
    return track.join(ends, F.col("tr_id").eqNullSafe(F.col("_e"))).where(F.col("ts") >= F.col("_end") - window_s).drop("_e", "_end")


def longest_stop(track: DataFrame, window_s: float = 900.0, slow: float = 2.5, least_s: float = 120.0, lat0: float = 55.75) -> DataFrame:
    """Each vehicle's longest run of slow steps in the last window_s seconds, the first of equals: tr_id, since, seconds, lat, lon (the run's middle fix).

    A step belongs to a run if its mean speed is below slow; runs shorter than
    least_s give no row.
    """
    order = Window.partitionBy("tr_id").orderBy("ts")
    recent = _recent(track, window_s)
    step = planar_m(F.col("lat"), F.col("lon"), F.lag("lat").over(order), F.lag("lon").over(order), F.lit(lat0)) / F.nullif(F.col("ts") - F.lag("ts").over(order), F.lit(0).cast("double"))
    s = recent.withColumn("low", F.coalesce(step < slow, F.lit(False)))
    s = s.withColumn("run", F.sum((~F.col("low")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.groupBy("tr_id", "run").agg(F.min("ts").alias("since"), (F.max("ts") - F.min("ts")).alias("seconds"), F.array_sort(F.collect_list(F.struct("ts", "lat", "lon"))).alias("f"))
    mid = F.get("f", F.floor(F.size("f") / 2).cast("int"))
    best = runs.where(F.col("seconds") >= least_s).withColumn("m", mid).groupBy("tr_id").agg(F.max(F.struct("seconds", (-F.col("since")).alias("minus"), "m")).alias("x"))
    return best.select("tr_id", (-F.col("x.minus")).alias("since"), "x.seconds", "x.m.lat", "x.m.lon")


def thin(ts: np.ndarray, apart: float = 10.0, most: int = 90) -> np.ndarray:
    """Positions to keep, `most` at most: each at least `apart` after the last kept one, then every k-th; the last fix
    always, in place of the last of these where it isn't one of them."""
    n = len(ts)
    if n < 3:
        return np.arange(n)
    kept, at = [0], 0
    while (nxt := int(np.searchsorted(ts, ts[at] + apart))) < n - 1:
        kept.append(nxt)
        at = nxt
    kept.append(n - 1)
    if len(kept) > most:
        kept = kept[:: -(-len(kept) // most)]
        kept[-1] = n - 1
    return np.array(kept)


def _chains(ts: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """For a chain that begins at each fix: the last fix it keeps, and how many; by pointers that double."""
    n = len(ts)
    jump, end, count = np.append(np.searchsorted(ts, ts + apart), n), np.arange(n + 1), np.append(np.ones(n, np.int64), 0)
    while (jump[:n] < n).any():
        end = np.where(jump < n, end[jump], end)
        count = count + count[jump]
        jump = jump[jump]
    return end[:n], count[:n]


def decimate(track: DataFrame, apart: float = 10.0, most: int = 90, width: int = 86_400) -> DataFrame:
    """thin() of each vehicle's track, of any length.

    A vehicle's fixes are dealt to buckets of `width` seconds, more than apart.  In
    each bucket pointers to the next kept fix say where every chain that may come
    in ends; the buckets' chains are joined in order, and each bucket's kept fixes
    numbered; every k-th of them stays.  Of fixes of one second the first by the
    other columns counts.
    """
    others = [c for c in track.columns if c not in ("tr_id", "ts")]
    width = max(width, int(4 * apart) + 1)

    def times(t: pa.Table) -> np.ndarray:
        return np.sort(t.column("ts").to_numpy().astype(float))

    def first(t: pa.Table) -> pa.Table:
        ts, b = times(t), t.column("_b")[0].as_py()
        end, count = _chains(ts, apart)
        entries = np.arange(min(len(ts), int(np.searchsorted(ts, b * width + apart)) + 1))  # no chain from before comes in later
        return pa.table({
            "tr_id": t.column("tr_id").slice(0, 1), "_b": t.column("_b").slice(0, 1), "_entry": pa.array([ts[entries]], pa.list_(pa.float64())), "_exit": pa.array([ts[end[entries]]], pa.list_(pa.float64())),
            "_count": pa.array([count[entries]], pa.list_(pa.int64())),
        })

    def over(t: pa.Table) -> pa.Table:
        t = t.sort_by("_b")
        entry, offset, last, done = [], [], None, 0
        for starts, ends, counts in zip(*(t.column(c).to_pylist() for c in ("_entry", "_exit", "_count")), strict=True):
            at = 0 if last is None else int(np.searchsorted(starts, last + apart))
            entry.append(starts[at] if at < len(starts) else None)
            offset.append(done)
            if at < len(starts):
                last, done = ends[at], done + counts[at]
        return pa.table({"tr_id": t.column("tr_id"), "_b": t.column("_b"), "_from": pa.array(entry, pa.float64()), "_offset": pa.array(offset, pa.int64())})

    schema = [*track.columns, "_kept", "_last"]

    def last(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("ts", *others)])
        ts, at = t.column("ts").to_numpy().astype(float), t.column("_from")[0].as_py()
        kept = np.full(len(ts), -1, np.int64)
        number, i = t.column("_offset")[0].as_py(), len(ts) if at is None else int(np.searchsorted(ts, at))
        while i < len(ts):
            kept[i], number, i = number, number + 1, int(np.searchsorted(ts, ts[i] + apart))
        end = np.arange(len(ts)) == len(ts) - 1
        keep = (kept >= 0) | end
        return t.append_column("_kept", pa.array(kept)).append_column("_last", pa.array(end)).select(schema).filter(pa.array(keep))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in track.schema.fields) + ", _kept long, _last boolean"
    kept = saved(three_passes(track, "tr_id", "ts", width, first, "_entry array<double>, _exit array<double>, _count array<long>", over, "_from double, _offset long", last, out))
    # Without the vehicle's very last fix, which stays in any case, the chain has `n` fixes.
    totals = kept.where("_last").groupBy("tr_id").agg(F.max("ts").alias("t_end")).withColumnRenamed("tr_id", "t_tr")
    counted = kept.join(totals, F.col("tr_id").eqNullSafe(F.col("t_tr")))
    is_end = F.col("_last") & (F.col("ts") == F.col("t_end"))
    sizes = counted.groupBy("t_tr").agg(F.max(F.when((F.col("_kept") >= 0) & ~is_end, F.col("_kept") + 1)).alias("n")).withColumnRenamed("t_tr", "n_tr")
    chosen = counted.join(sizes, F.col("tr_id").eqNullSafe(F.col("n_tr")))
    n = F.coalesce("n", F.lit(0))
    step = F.greatest(F.lit(1), F.ceil((n + 1) / most))
    replaced = (n % step != 0) & (F.col("_kept") == F.floor(n / step) * step)
    return chosen.where(is_end | ((F.col("_kept") >= 0) & (F.col("_kept") % step == 0) & ~replaced)).select(*track.columns)


class Roads:
    """A corridor's graph in local metres, for one vehicle's track."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame, lat0: float, lon0: float) -> None:
        self.lat0, self.lon0, self.scale = lat0, lon0, LON_M * math.cos(math.radians(lat0))
        self.xy = {i: (x, y) for i, x, y in zip(nodes["node_id"], (nodes["lon"] - lon0) * self.scale, (nodes["lat"] - lat0) * LAT_M, strict=True)}
        known = edges["u"].isin(self.xy) & edges["v"].isin(self.xy)
        self.u, self.v = edges["u"][known].tolist(), edges["v"][known].tolist()
        self.a = np.array([self.xy[i] for i in self.u]).reshape(-1, 2)
        self.b = np.array([self.xy[i] for i in self.v]).reshape(-1, 2)
        self.length = np.hypot(*(self.b - self.a).T) if len(self.u) else np.zeros(0)
        self.near: dict[int, list[tuple[int, float]]] = {}
        for i, j, d in zip(self.u, self.v, self.length.tolist(), strict=True):
            self.near.setdefault(i, []).append((j, d))
            self.near.setdefault(j, []).append((i, d))

    def candidates(self, x: float, y: float, radius: float, most: int) -> list[tuple[int, float, float]]:
        """(edge, fraction along it, distance) of the closest edges."""
        if not len(self.u):
            return []
        d = self.b - self.a
        t = np.clip(((np.array([x, y]) - self.a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-9), 0, 1)
        away = np.hypot(*(self.a + d * t[:, None] - np.array([x, y])).T)
        order = np.argsort(away, kind="stable")[:most]
        return [(int(e), float(t[e]), float(away[e])) for e in order if away[e] <= radius]

    def distances(self, start: int, limit: float) -> dict[int, float]:
        best, queue = {start: 0.0}, [(0.0, start)]
        while queue:
            d, i = heapq.heappop(queue)
            if d > best[i]:
                continue
            for j, w in self.near.get(i, ()):
                if d + w < best.get(j, limit + 1e-9):
                    best[j] = d + w
                    heapq.heappush(queue, (d + w, j))
        return best

    def point(self, edge: int, t: float) -> tuple[float, float]:
        x, y = self.a[edge] + (self.b[edge] - self.a[edge]) * t
        return self.lat0 + y / LAT_M, self.lon0 + x / self.scale


def viterbi(roads: Roads, x: np.ndarray, y: np.ndarray, radius: float = 300.0, noise: float = 25.0, beta: float = 30.0, most: int = 10) -> list[tuple[int, int, float]]:
    """The likeliest (observation, edge, fraction) along the track; after a break it starts anew."""
    out: list[tuple[int, int, float]] = []
    states: list[tuple[int, float, float]] = []
    score: list[float] = []
    trail: list[tuple[int, list, list]] = []  # observation, states, predecessors
    cache: dict[int, tuple[float, dict[int, float]]] = {}  # by start: the limit searched to, distances

    def finish() -> None:
        if trail:
            k = int(np.argmax(score))
            part = []
            for i, s, back in reversed(trail):
                part.append((i, s[k][0], s[k][1]))
                k = back[k]
            out.extend(reversed(part))

    for i in range(len(x)):
        found = roads.candidates(x[i], y[i], radius, most)
        if not found:
            continue
        emit = [-(d * d) / (2 * noise * noise) for _, _, d in found]
        if trail:
            j = trail[-1][0]
            straight = math.hypot(x[i] - x[j], y[i] - y[j])
            limit = round(2 * straight + 4 * radius)
            new, back = [], []
            for e, t, _ in found:
                best, frm = -math.inf, 0
                for k, (pe, pt, _) in enumerate(states):
                    if e == pe:
                        route = abs(t - pt) * roads.length[e]
                    else:
                        route = math.inf
                        for pn, pd_ in ((roads.u[pe], pt), (roads.v[pe], 1 - pt)):
                            far, reach = cache.get(pn, (-1.0, {}))
                            if far < limit:
                                far, reach = cache[pn] = (1.5 * limit, roads.distances(pn, 1.5 * limit))
                            for n, nd in ((roads.u[e], t), (roads.v[e], 1 - t)):
                                if reach.get(n, math.inf) < limit + 1e-9:
                                    route = min(route, pd_ * roads.length[pe] + reach[n] + nd * roads.length[e])
                    s = score[k] - abs(route - straight) / beta
                    if s > best:
                        best, frm = s, k
                new.append(best)
                back.append(frm)
            if max(new) == -math.inf:  # no way leads here
                finish()
                trail, score = [], list(emit)
                trail.append((i, found, [0] * len(found)))
            else:
                score = [a + b for a, b in zip(new, emit, strict=True)]
                trail.append((i, found, back))
        else:
            score = list(emit)
            trail.append((i, found, [0] * len(found)))
        states = found
    finish()
    return out


def snap(track: DataFrame, nodes: DataFrame, edges: DataFrame, window_s: float = 720.0, pad_m: float = 300.0, apart: float = 10.0, most: int = 90) -> DataFrame:
    """Each vehicle's last window_s seconds on the roads: SNAPPED, a row per matched fix; fewer than two give none.

    Each vehicle gets the edges of the grid cells that its own fixes touch, by a
    cogrouped join, so a task holds one vehicle's few minutes and their corridor.
    """
    recent = _recent(track, window_s).select("tr_id", F.col("ts").cast("double").alias("ts"), "lat", "lon")
    lat0 = 55.75
    lon_m = LON_M * math.cos(math.radians(lat0))
    size = 2 * pad_m
    cell = lambda c, m: F.floor(F.col(c) * m / size)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    cells = recent.select("tr_id", cell("lat", LAT_M).alias("ci"), cell("lon", lon_m).alias("cj")).distinct().select("tr_id", around.alias("o"), "ci", "cj").select(
        "tr_id", (F.col("ci") + F.col("o.i")).alias("ci"), (F.col("cj") + F.col("o.j")).alias("cj")
    ).distinct()
    a = nodes.select(F.col("node_id").alias("u"), F.col("lat").alias("ulat"), F.col("lon").alias("ulon"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("lat").alias("vlat"), F.col("lon").alias("vlon"))
    full = edges.join(a, "u").join(b, "v")
    ends = full.select("*", F.explode(F.array_distinct(F.array(*(F.struct(F.floor(F.col(f"{e}lat") * LAT_M / size).alias("ci"), F.floor(F.col(f"{e}lon") * lon_m / size).alias("cj")) for e in "uv")))).alias("c"))
    mine = cells.join(ends.select("u", "v", "ulat", "ulon", "vlat", "vlon", "c.ci", "c.cj"), ["ci", "cj"]).drop("ci", "cj").distinct().withColumnRenamed("tr_id", "e_tr")

    def one(t: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("ts").reset_index(drop=True)
        t = t.iloc[thin(t["ts"].to_numpy(), apart, most)].reset_index(drop=True)
        none = pd.DataFrame({c.split()[0]: pd.Series(dtype="int64" if "long" in c else "float64") for c in SNAPPED.split(", ")})
        if t.empty or e.empty:
            return none
        la, lo = float(t["lat"].median()), float(t["lon"].median())
        n = pd.concat([e[["u", "ulat", "ulon"]].set_axis(["node_id", "lat", "lon"], axis=1), e[["v", "vlat", "vlon"]].set_axis(["node_id", "lat", "lon"], axis=1)]).drop_duplicates("node_id")
        roads = Roads(n, e, la, lo)
        got = viterbi(roads, ((t["lon"] - lo) * roads.scale).to_numpy(), ((t["lat"] - la) * LAT_M).to_numpy(), radius=pad_m)
        if len(got) < 2:
            return none
        places = [roads.point(edge, f) for _, edge, f in got]
        i = [k for k, _, _ in got]
        return pd.DataFrame({"tr_id": t["tr_id"].iloc[i].to_numpy(), "ts": t["ts"].iloc[i].to_numpy(), "lat": [q[0] for q in places], "lon": [q[1] for q in places], "raw_lat": t["lat"].iloc[i].to_numpy(), "raw_lon": t["lon"].iloc[i].to_numpy()})

    # The rows are few and the work on them is not, so adaptive execution would gather it in one task.  A number of parts
    # of its own keeps it apart; the session's number would be taken for the partitioning that is there already.
    parts = 2 * int(track.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return recent.repartition(parts, "tr_id").groupBy("tr_id").cogroup(mine.repartition(parts, "e_tr").groupBy("e_tr")).applyInPandas(one, SNAPPED)


def snapped_delays(snapped: DataFrame, schedule: DataFrame, radius_m: float = 90.0, window_s: float = 300.0) -> DataFrame:
    """Delays of stops from snapped tracks, passing times interpolated along segments: tt_action_item_id, est_delay_s.

    Of all segments within radius and window the one with the least |delay| counts.
    """
    order = Window.partitionBy("tr_id").orderBy("ts", "lat", "lon")
    nxt = {c: F.lead(c).over(order) for c in ("ts", "lat", "lon")}
    return passage_delays(snapped.select("tr_id", "ts", "lat", "lon", *(F.coalesce(e, F.col(c)).alias(f"n_{c}") for c, e in nxt.items())), schedule, radius_m, window_s)


def passages(seg: DataFrame, schedule: DataFrame, radius_m: float = 90.0, window_s: float = 300.0) -> DataFrame:
    """Where the steps of tracks (tr_id, ts, lat, lon, n_ts, n_lat, n_lon) pass stops within radius and window: the stop, ts, n_ts and delay."""
    b = lambda x: F.floor(x / window_s)
    stops = schedule.select("tr_id", "tt_action_item_id", "plan_s", "stop_lat", "stop_lon", F.explode(F.sequence(b(F.col("plan_s") - window_s), b(F.col("plan_s") + window_s))).alias("b"))
    seg = seg.withColumn("b", F.explode(F.sequence(b(F.col("ts")), b(F.col("n_ts")))))
    m = lambda c: (F.col(c) - F.col("lon" if "lon" in c else "lat")) * (LON_M * F.cos(F.radians("stop_lat")) if "lon" in c else F.lit(LAT_M))
    dx, dy, px, py = m("n_lon"), m("n_lat"), m("stop_lon"), m("stop_lat")
    t = F.least(F.greatest((px * dx + py * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    near = seg.join(stops, ["tr_id", "b"]).withColumns({"away": F.hypot(px - t * dx, py - t * dy), "delay": F.col("ts") + t * (F.col("n_ts") - F.col("ts")) - F.col("plan_s")})
    near = near.where((F.col("away") <= radius_m) & (F.abs("delay") <= window_s))
    return near.select("tr_id", "tt_action_item_id", "plan_s", "ts", "n_ts", "delay").distinct()


def passage_delays(seg: DataFrame, schedule: DataFrame, radius_m: float = 90.0, window_s: float = 300.0) -> DataFrame:
    """snapped_delays() of the steps of tracks."""
    return passages(seg, schedule, radius_m, window_s).groupBy("tt_action_item_id").agg(F.min_by("delay", F.struct(F.abs("delay"), "ts")).alias("est_delay_s"))


def refined_delays(matched: DataFrame, snapped: DataFrame) -> DataFrame:
    """Delays of matched stops (match_stops), replaced by those of snapped tracks (snapped_delays) where there are any.

    tr_id, tt_action_item_id, plan_s, est_delay_s and origin: track, radius, or null for a stop without a delay.
    """
    better = snapped.select("tt_action_item_id", F.col("est_delay_s").alias("on_track"))
    both = matched.join(better, "tt_action_item_id", "left")
    origin = F.when(F.col("on_track").isNotNull(), "track").when(F.col("est_delay_s").isNotNull(), "radius")
    return both.select("tr_id", "tt_action_item_id", "plan_s", F.coalesce("on_track", "est_delay_s").alias("est_delay_s"), origin.alias("origin"))


def smoothed(values: DataFrame, key: str, order: str, value: str, low: float, high: float, width: int = 86_400) -> DataFrame:
    """Adds smooth, an exponential mean with weight one half over all values so far, clamped: what a moving marker shows.

    A bucket of `width` turns the mean m that comes in after n values into
    m / 2**n plus what its own values give; these maps are joined from bucket to
    bucket.  Missing values leave the mean as it is.
    """
    kinds, names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields), values.columns

    def ordered(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        t = t.sort_by([(order, "ascending"), (value, "ascending")])
        return t, t.column(value).cast(pa.float64()).to_numpy()  # nan where there is none

    def first(t: pa.Table) -> pa.Table:
        _, x = ordered(t)
        x, m = x[~np.isnan(x)], 0.0
        for v in x:
            m = (m + v) / 2
        return pa.table({key: t.column(key).slice(0, 1), "_b": t.column("_b").slice(0, 1), "_n": [len(x)], "_own": [float(m)], "_x": pa.array([float(x[0]) if len(x) else None], pa.float64())})

    def over(t: pa.Table) -> pa.Table:
        t, m, known, seen = t.sort_by("_b"), None, [], []
        for n, own, x in zip(*(t.column(c).to_pylist() for c in ("_n", "_own", "_x")), strict=True):
            seen.append(m is not None)
            m = x if m is None else m  # the first value is the mean before it
            known.append(m)
            m = m if n == 0 else math.ldexp(m, -n) + own
        return pa.table({key: t.column(key), "_b": t.column("_b"), "_in": pa.array(known, pa.float64()), "_seen": seen})

    def last(t: pa.Table) -> pa.Table:
        t, x = ordered(t)
        m, seen, out = t.column("_in")[0].as_py(), t.column("_seen")[0].as_py(), []
        for v in x.tolist():
            if not math.isnan(v):
                m, seen = (m + v) / 2, True
            out.append(m if seen else None)
        return t.select(names).append_column("smooth", pa.array(out, pa.float64()))

    found = three_passes(values, key, order, width, first, "_n long, _own double, _x double", over, "_in double, _seen boolean", last, f"{kinds}, smooth double")
    return found.withColumn("smooth", F.when(F.col("smooth").isNotNull(), F.least(F.greatest(F.col("smooth"), F.lit(low)), F.lit(high))))
