"""Map matching that goes on from fix to fix: a lattice whose settled columns are given out while the rest is carried.

The model is Newson and Krumm's (2009): nearby edges are the states, their
distance from the fix gives the emission, the difference of the route's length
and the straight line the transition.  The nodes that a route passes between two
fixes are its non-emitting states and come with the later fix.  As soon as all
survivors of the lattice come from one state, everything up to it is settled: no
later fix can change it.  So a track gives the same result however it is cut.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.geo import LAT_M, LON_M
from tramline.operators.scan import Buckets, saved, sessions

#: A matched fix: where it lies on the edge u-v (u < v), at which share of it, and the nodes passed since the fix before.
MATCHED = "tr_id long, ts long, lat double, lon double, raw_lat double, raw_lon double, u long, v long, along double, via array<long>, starts boolean"
ROADS = "array<struct<u:bigint,v:bigint,ulat:double,ulon:double,vlat:double,vlon:double>>"


@dataclass(frozen=True)
class Rule:
    """How fixes are matched.

    Fixes come at least `apart` seconds one after the other; a pause of more than
    `gap` seconds, a fix without an edge within `radius` metres, or no way between
    two fixes ends a track, and the next one starts anew.  After a fix without an
    edge the vehicle isn't tried again for `wait` seconds, and for twice as long
    after each further one, `wait_most` at most.  A column that is `lag` columns
    back and not settled is settled by the likeliest survivor.
    """

    radius: float = 300.0
    noise: float = 25.0
    beta: float = 30.0
    most: int = 10
    apart: int = 10
    gap: int = 600
    wait: int = 30
    wait_most: int = 600
    lag: int = 60
    lat0: float = 55.75

    @property
    def lon_m(self) -> float:
        return LON_M * math.cos(math.radians(self.lat0))


class Net:
    """The edges around one fix or two, in metres."""

    def __init__(self, edges: dict[tuple[int, int], tuple[float, float, float, float]]) -> None:
        self.names = sorted(edges)
        ends = np.array([edges[n] for n in self.names], float).reshape(-1, 4)
        self.a, self.d = ends[:, :2], ends[:, 2:] - ends[:, :2]
        self.length = dict(zip(self.names, np.hypot(self.d[:, 0], self.d[:, 1]).tolist(), strict=True))
        self.near: dict[int, list[tuple[int, float]]] = {}
        for (u, v), m in self.length.items():
            self.near.setdefault(u, []).append((v, m))
            self.near.setdefault(v, []).append((u, m))
        self.known: dict[int, tuple[float, dict[int, tuple[float, int]]]] = {}

    def candidates(self, x: float, y: float, rule: Rule) -> list[tuple]:
        """(u, v, along, distance, x, y) of the closest edges, nearest first; equally far ones by name."""
        if not self.names:
            return []
        p = np.array([x, y])
        t = np.clip(((p - self.a) * self.d).sum(1) / np.maximum((self.d**2).sum(1), 1e-9), 0, 1)
        at = self.a + self.d * t[:, None]
        away = np.round(np.hypot(at[:, 0] - x, at[:, 1] - y), 6)
        order = np.argsort(away, kind="stable")[: rule.most]
        return [(*self.names[i], float(t[i]), float(away[i]), float(at[i, 0]), float(at[i, 1])) for i in order.tolist() if away[i] <= rule.radius]

    def ways(self, start: int, limit: float) -> dict[int, tuple[float, int]]:
        """Distance and predecessor of the nodes within limit."""
        far, found = self.known.get(start, (-1.0, {}))
        if far >= limit:
            return found
        limit *= 1.25  # what lies within a limit is the same in a wider search, and the next limit may be a little larger
        best, queue, found = {start: 0.0}, [(0.0, start, start)], {}
        while queue:
            d, i, before = heapq.heappop(queue)
            if i in found:
                continue
            found[i] = (d, before)
            for j, m in self.near.get(i, ()):
                if j not in found and d + m <= limit and d + m <= best.get(j, math.inf):
                    best[j] = d + m
                    heapq.heappush(queue, (d + m, j, i))
        self.known[start] = (limit, found)
        return found

    def route(self, a: tuple, b: tuple, limit: float) -> tuple[float, list[int]]:
        """Length of the way from one candidate to another and the nodes on it; infinite without a way."""
        if a[:2] == b[:2]:
            return abs(a[2] - b[2]) * self.length.get(a[:2], 0.0), []
        whole, start, end = self.shortest(self.leaving(a, limit), b, limit)
        return (whole, self.passed(start, end, limit)) if start is not None else (whole, [])

    def leaving(self, a: tuple, limit: float) -> list[tuple]:
        """For both ends of a candidate's edge: the end, how far it is, and what is within limit of it."""
        m = self.length[a[:2]]
        return [(a[0], a[2] * m, self.ways(a[0], limit)), (a[1], (1 - a[2]) * m, self.ways(a[1], limit))]

    def shortest(self, leaving: list[tuple], b: tuple, limit: float) -> tuple[float, int | None, int | None]:
        """Length of the way to a candidate on another edge, and the nodes where it leaves and enters."""
        m, best = self.length[b[:2]], (math.inf, None, None)
        for end, after in ((b[0], b[2] * m), (b[1], (1 - b[2]) * m)):
            for start, before, reach in leaving:
                if end in reach:
                    whole = before + reach[end][0] + after
                    if whole <= limit and (whole < best[0] or (whole == best[0] and start == leaving[0][0] != best[1])):
                        best = (whole, start, end)
        return best

    def passed(self, start: int, end: int, limit: float) -> list[int]:
        """The nodes of the way from one node to another."""
        reach, nodes = self.ways(start, limit), [end]
        while nodes[-1] != start:
            nodes.append(reach[nodes[-1]][1])
        return nodes[::-1]


class Nets:
    """The nets of a task's fixes: what is known of one place serves all fixes there.  The last `most` are kept."""

    def __init__(self, most: int = 256) -> None:
        self.most = most
        self.kept: dict[tuple[int, int], tuple[dict, dict, Net]] = {}

    def of(self, before: dict, here: dict) -> Net:
        """The net of the edges around one fix (before is here) or two."""
        key = (id(before), id(here))  # both are held, so no other edges get their ids
        if key not in self.kept:
            if len(self.kept) >= self.most:
                del self.kept[next(iter(self.kept))]
            self.kept[key] = (before, here, Net(here if before is here else {**before, **here}))
        return self.kept[key][2]


def _edges(roads: list | None, rule: Rule) -> dict[tuple[int, int], tuple[float, float, float, float]]:
    """The edges of a fix by their ends, the smaller first, with the places of both in metres."""
    out = {}
    for r in roads or ():
        (u, ux, uy), (v, vx, vy) = sorted(((r["u"], r["ulon"], r["ulat"]), (r["v"], r["vlon"], r["vlat"])))
        out[u, v] = (ux * rule.lon_m, uy * LAT_M, vx * rule.lon_m, vy * LAT_M)
    return out


@dataclass
class Lattice:
    """One vehicle's open columns.  A column: fix (ts, lat, lon), states, predecessors, nodes passed, whether it starts a track."""

    rule: Rule
    columns: list[list] = field(default_factory=list)
    score: list[float] = field(default_factory=list)
    seen_ts: int | None = None  # of the last fix
    last_ts: int | None = None  # of the last one that was looked at
    resume: int | None = None  # no fix is looked at before
    wait: int = 0
    edges: dict = field(default_factory=dict)  # around the last fix
    nets: Nets = field(default_factory=lambda: Nets(2), repr=False, compare=False)

    def push(self, ts: int, lat: float, lon: float, roads: list | dict | None) -> list[tuple]:
        """Goes on by one fix, not earlier than the one before; what is settled by it.  roads may be what _edges() makes of them."""
        r, out = self.rule, []
        if self.seen_ts is not None and ts - self.seen_ts > r.gap:
            out, self.last_ts, self.resume, self.wait = self.finish(), None, None, 0
        self.seen_ts = ts
        if (self.last_ts is not None and ts < self.last_ts + r.apart) or (self.resume is not None and ts < self.resume):
            return out
        out += self.finish() if self.last_ts is not None and ts - self.last_ts > r.gap else []
        self.last_ts = ts
        here = roads if isinstance(roads, dict) else _edges(roads, r)
        x, y = lon * r.lon_m, lat * LAT_M
        found = self.nets.of(here, here).candidates(x, y, r)
        if not found:
            out += self.finish()
            self.wait = min(max(2 * self.wait, r.wait), r.wait_most)
            self.resume = ts + self.wait
            return out
        self.wait, self.resume = 0, None
        emit = [-(s[3] ** 2) / (2 * r.noise**2) for s in found]
        fix = [ts, lat, lon]
        if self.columns:
            score, back, via = self._steps(found, self.nets.of(self.edges, here), x, y)
            if max(score) > -math.inf:
                self.columns.append([fix, [list(s) for s in found], back, via, False])
                self.score = [a + b for a, b in zip(score, emit, strict=True)]
                self.edges = here
                return out + self._settled()
            out += self.finish()
        self.columns, self.score, self.edges = [[fix, [list(s) for s in found], [], [], True]], emit, here
        return out

    def _steps(self, found: list[tuple], net: Net, x: float, y: float) -> tuple[list[float], list[int], list[list[int]]]:
        """For each new state the best sum of a survivor and the step from it, that survivor, and the nodes on the way."""
        (_, lat, lon), states, *_ = self.columns[-1]
        straight = math.hypot(x - lon * self.rule.lon_m, y - lat * LAT_M)
        limit = 2 * straight + 4 * self.rule.radius
        beta = self.rule.beta
        # The best survivors first: a step only takes from a score, so those behind one that does better need not be looked at.
        live = sorted((i for i, s in enumerate(self.score) if s > -math.inf), key=lambda i: -self.score[i])
        most, leaving = {i: round(self.score[i], 9) for i in live}, {}
        score, back, via = [], [], []
        for s in found:
            best, k, way, edge = -math.inf, 0, None, s[:2]
            for i in live:
                if most[i] < best:
                    break
                p = states[i]
                if p[0] == edge[0] and p[1] == edge[1]:
                    length, start, end = abs(p[2] - s[2]) * net.length[edge], None, None
                else:
                    if i not in leaving:
                        leaving[i] = net.leaving(tuple(p), limit)
                    length, start, end = net.shortest(leaving[i], s, limit)
                value = round(self.score[i] - abs(length - straight) / beta, 9) if length < math.inf else -math.inf
                if value > best or (value == best > -math.inf and i < k):
                    best, k, way = value, i, (start, end)
            score.append(best)
            back.append(k)
            via.append(net.passed(*way, limit) if way and way[0] is not None else [])
        return score, back, via

    def _settled(self) -> list[tuple]:
        given = self.columns[0][4] is None  # the first column is the root of the others and was given out
        alive = {k for k, s in enumerate(self.score) if s > -math.inf}
        for c in range(len(self.columns) - 1, int(given), -1):
            alive = {self.columns[c][2][k] for k in alive}
            if len(alive) == 1:
                return self._give(c, alive.pop())
        if len(self.columns) > self.rule.lag:
            at = list(range(len(self.score)))  # each survivor's state in the first column that isn't given out
            for c in range(len(self.columns) - 1, int(given), -1):
                at = [self.columns[c][2][k] for k in at]
            best = at[self.score.index(max(self.score))]
            self.score = [s if k == best else -math.inf for s, k in zip(self.score, at, strict=True)]
            return self._give(1 + int(given), best)
        return []

    def _give(self, until: int, k: int) -> list[tuple]:
        """Rows of the columns before `until`, of which the last one is in state k; they are dropped."""
        rows = self._trace(until - 1, k)
        (fix, states, back, via, starts) = self.columns[until - 1]
        del self.columns[: until - 1]
        # The last settled column stays as the root of those behind it, marked as given.
        self.columns[0] = [fix, states, back, via, None]
        return rows

    def _trace(self, c: int, k: int) -> list[tuple]:
        rows = []
        while c >= 0:
            fix, states, back, via, starts = self.columns[c]
            if starts is not None:
                u, v, along, _, x, y = states[k]
                rows.append((fix[0], y / LAT_M, x / self.rule.lon_m, fix[1], fix[2], u, v, along, via[k] if via else [], bool(starts)))
            k = back[k] if back and c else 0
            c -= 1
        return rows[::-1]

    def tail(self) -> list[tuple]:
        """The likeliest way through the columns that aren't settled, which a later fix may change."""
        return self._trace(len(self.columns) - 1, self.score.index(max(self.score))) if self.columns else []

    def finish(self) -> list[tuple]:
        """Settles all that is open; the next fix starts anew."""
        rows = self.tail()
        self.columns, self.score, self.edges = [], [], {}
        return rows

    def dump(self) -> str:
        """The state as text."""
        return json.dumps([self.columns, [None if s == -math.inf else s for s in self.score], self.seen_ts, self.last_ts, self.resume, self.wait, [[*k, *v] for k, v in self.edges.items()]])

    @staticmethod
    def load(rule: Rule, text: str | None) -> Lattice:
        if not text:
            return Lattice(rule)
        columns, score, seen_ts, last_ts, resume, wait, edges = json.loads(text)
        return Lattice(rule, columns, [-math.inf if s is None else s for s in score], seen_ts, last_ts, resume, wait, {(e[0], e[1]): tuple(e[2:]) for e in edges})


def packed(roads: DataFrame) -> DataFrame:
    """The roads of cells (ci, cj) as bytes, each cell's packed once: a fix then carries a few kilobytes and no nested rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, fields = b.column("roads").offsets.to_numpy(), [f.to_numpy() for f in b.column("roads").values.flatten()]
            made = [zlib.compress(b"".join(f[i:j].tobytes() for f in fields), 1) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("ci"), b.column("cj"), pa.array(made, pa.binary())], names=["ci", "cj", "roads"])

    return roads.mapInArrow(run, "ci long, cj long, roads binary")


def unpacked(data: bytes, rule: Rule) -> dict[tuple[int, int], tuple[float, float, float, float]]:
    """What _edges() makes of the roads that packed() made these bytes of, decompressed."""
    n = len(data) // 48
    columns = [*np.frombuffer(data[: 16 * n], np.int64).reshape(2, n).tolist(), *np.frombuffer(data[16 * n :]).reshape(4, n).tolist()]
    return _edges([dict(zip(("u", "v", "ulat", "ulon", "vlat", "vlon"), r, strict=True)) for r in zip(*columns, strict=True)], rule)


def roads_around(nodes: DataFrame, edges: DataFrame, rule: Rule) -> DataFrame:
    """For each cell (ci, cj) that has any the roads, the edges that touch the cells around it.

    Cells are as wide as the radius.  An edge is in every cell of the box around
    it; the edges around a cell are gathered once, so what a fix needs is bounded
    by the density of roads.
    """
    a = nodes.select(F.col("node_id").alias("u"), F.col("lat").alias("ulat"), F.col("lon").alias("ulon"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("lat").alias("vlat"), F.col("lon").alias("vlon"))
    cell = lambda c, m: F.floor(c * m / rule.radius)
    span = lambda x, y, m: F.sequence(cell(F.least(x, y), m) - 1, cell(F.greatest(x, y), m) + 1)
    full = edges.select("u", "v").join(a, "u").join(b, "v")
    spread = full.select("*", F.explode(span(F.col("ulat"), F.col("vlat"), LAT_M)).alias("ci")).select("*", F.explode(span(F.col("ulon"), F.col("vlon"), rule.lon_m)).alias("cj"))
    return spread.groupBy("ci", "cj").agg(F.collect_set(F.struct("u", "v", "ulat", "ulon", "vlat", "vlon")).alias("roads"))


def in_cells(fixes: DataFrame, rule: Rule) -> DataFrame:
    """fixes with their cell (ci, cj)."""
    cell = lambda c, m: F.floor(F.col(c) * m / rule.radius)
    return fixes.withColumns({"ci": cell("lat", LAT_M), "cj": cell("lon", rule.lon_m)})


def with_roads(fixes: DataFrame, nodes: DataFrame, edges: DataFrame, rule: Rule, pack: bool = False) -> DataFrame:
    """fixes with their cell (ci, cj) and its roads (packed() on demand); null far from any road."""
    around = roads_around(nodes, edges, rule)
    return in_cells(fixes, rule).join(saved(packed(around)) if pack else around, ["ci", "cj"], "left")


def _dealt(parts: DataFrame, nodes: DataFrame, edges: DataFrame, rule: Rule) -> DataFrame:
    """parts (tr_id, part, ts, lat, lon) spread over tasks, each part in order, after the packed roads of the task's cells.

    A fix is shuffled without its roads; those of a cell come once to each task
    that has a fix there.
    """
    # The work on a row is much, so adaptive execution mustn't gather parts.
    count = 2 * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = in_cells(parts, rule).withColumn("task", F.pmod(F.hash("tr_id", "part"), F.lit(count)))
    cells = placed.select("task", "ci", "cj").distinct().join(packed(roads_around(nodes, edges, rule)), ["ci", "cj"])
    kinds = dict(placed.dtypes)
    none = {c: F.lit(None).cast(kinds[c]) for c in parts.columns}
    both = cells.withColumns(none | {"fix": F.lit(False)}).unionByName(placed.withColumns({"fix": F.lit(True), "roads": F.lit(None).cast("binary")}))
    return both.repartitionById(count, "task").drop("task").sortWithinPartitions("fix", "tr_id", "part", "ts")


def _match(fixes: DataFrame, nodes: DataFrame, edges: DataFrame, rule: Rule, of_part: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, out: str) -> DataFrame:
    """Every vehicle's whole track on the roads, as the rows that of_part makes of each part's matched fixes.

    fixes have tr_id, ts (whole seconds), lat and lon; of fixes of one second the
    one with the smaller place counts.  A vehicle's track is parted at pauses of
    more than rule.gap seconds, and the parts are spread over tasks, so a busy
    vehicle is too.  A task passes its parts fix by fix and holds the open columns
    of one, rule.lag at most, and the packed roads of its cells.  Fixes without a
    place are left out.
    """
    one = fixes.where("lat IS NOT NULL AND lon IS NOT NULL AND ts IS NOT NULL").groupBy("tr_id", F.col("ts").cast("long").alias("ts")).agg(F.min(F.struct("lat", "lon")).alias("p")).select("tr_id", "ts", "p.lat", "p.lon")
    parts = sessions(one, "tr_id", "ts", [], rule.gap).select("tr_id", "ts", "lat", "lon", F.col("session").alias("part"))
    names = ("fix", "tr_id", "part", "ts", "lat", "lon", "ci", "cj", "roads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets, known, places = Nets(), {}, {}

        def around(cell: tuple[int, int]) -> dict:
            if cell not in places:  # fixes of one cell have the same roads
                if len(places) >= 1024:
                    del places[next(iter(places))]
                places[cell] = unpacked(zlib.decompress(known[cell]), rule) if cell in known else {}
            return places[cell]

        def told() -> Iterator[tuple]:
            """The fixes, after the roads were taken in."""
            for batch in batches:
                for fix, *row, ci, cj, roads in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if fix:
                        yield (*row, (ci, cj))
                    else:
                        known[ci, cj] = roads

        def matched(rows: Iterator[tuple]) -> Iterator[tuple]:
            lattice = Lattice(rule, nets=nets)
            for tr_id, _, ts, lat, lon, cell in rows:
                yield from ((tr_id, *r) for r in lattice.push(ts, lat, lon, around(cell)))
            yield from ((tr_id, *r) for r in lattice.finish())

        found = (r for _, rows in itertools.groupby(told(), key=lambda x: x[:2]) for r in of_part(matched(rows)))
        while rows := list(itertools.islice(found, 10_000)):
            yield _batch(rows, schema)

    return _dealt(parts, nodes, edges, rule).mapInArrow(run, out)


def match_tracks(fixes: DataFrame, nodes: DataFrame, edges: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Every vehicle's whole track on the roads (_match()): MATCHED, a row per matched fix."""
    return _match(fixes, nodes, edges, rule or Rule(), lambda rows: rows, _ARROW, MATCHED)


def match_segments(fixes: DataFrame, nodes: DataFrame, edges: DataFrame, rule: Rule | None = None) -> DataFrame:
    """segments() of match_tracks(), made where a part is matched: what follows a part's last fix always starts anew."""

    def steps(rows: Iterator[tuple]) -> Iterator[tuple]:
        for here, after in itertools.pairwise(itertools.chain(rows, (None,))):
            yield (*here[:4], *(here if after is None or after[-1] else after)[1:4])

    return _match(fixes, nodes, edges, rule or Rule(), steps, _STEPS, SEGMENTS)


_ARROW = pa.schema(
    [("tr_id", pa.int64()), ("ts", pa.int64()), *((c, pa.float64()) for c in ("lat", "lon", "raw_lat", "raw_lon")), ("u", pa.int64()), ("v", pa.int64()), ("along", pa.float64()), ("via", pa.list_(pa.int64())), ("starts", pa.bool_())]
)


#: A step of a matched track: a fix and the next one.
SEGMENTS = "tr_id long, ts long, lat double, lon double, n_ts long, n_lat double, n_lon double"
_STEPS = pa.schema([("tr_id", pa.int64()), *((f"{n}{c}", pa.int64() if c == "ts" else pa.float64()) for n in ("", "n_") for c in ("ts", "lat", "lon"))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def segments(matched: DataFrame) -> DataFrame:
    """The steps of matched tracks: tr_id, ts, lat, lon and n_ts, n_lat, n_lon of the next fix; a track's last fix stands for itself.

    Neighbours are found within days and from day to day, so a busy vehicle is
    spread over tasks.
    """
    b = Buckets(matched, "tr_id", "ts", ["lat", "lon"])
    place = F.struct("ts", "lat", "lon", "starts")
    rows = b.df.withColumn("_next", F.lead(place).over(b.within))
    rows = b.carried(rows, {"_first": F.min(place)}, {"_after": F.lead("_first").over(b.over)})
    nxt = F.coalesce("_next", "_after")
    goes_on = nxt.isNotNull() & ~nxt["starts"]
    return rows.select("tr_id", "ts", "lat", "lon", *(F.when(goes_on, nxt[c]).otherwise(F.col(c)).alias(f"n_{c}") for c in ("ts", "lat", "lon")))
