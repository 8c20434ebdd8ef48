"""Map matching of a stream: each vehicle's lattice as keyed state.

What is settled is given out once; the open tail is given out anew with every
batch that reaches the vehicle, marked as such.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tramline.operators.lattice import MATCHED, Lattice, Nets, Rule, unpacked, with_roads

LIVE = f"{MATCHED}, settled boolean, seq long"
_STATE = "lattice binary, waiting binary, seq long"
_COLUMNS = [c.strip().split()[0] for c in MATCHED.split(",")][1:]


def match_stream(stream: DataFrame, nodes: DataFrame, edges: DataFrame, rule: Rule | None = None, late: str = "10 minutes") -> DataFrame:
    """match_tracks() of a stream with tr_id, ts, event_time, lat and lon: MATCHED, settled and seq (the vehicle's calls), to be appended.

    Fixes wait until the watermark has passed them and then go on in the order of
    their time, so the settled rows are those of match_tracks() whatever the cut
    and order in which fixes within `late` arrive.  A vehicle's state is its
    waiting fixes, the roads of each of their cells once, and at most rule.lag columns.  A timer goes off when the watermark
    passes its first waiting fix, or its last fix by more than rule.gap seconds: then
    its track is settled and the state removed.  The watermark, and whether a
    vehicle is tried again after a fix without an edge, are a matter of event time alone.
    """
    rule = rule or Rule()

    nets, places, shared = Nets(1024), {b"": {}}, {}  # of a task: vehicles of one cell have the same roads, and so the same nets

    def one(edges: dict) -> dict:
        """The same object for the same edges."""
        if len(shared) >= 1024:
            shared.clear()
        return shared.setdefault(tuple(sorted(edges.items())), edges)

    def around(roads: bytes) -> dict:
        if roads not in places:
            if len(places) >= 1024:
                del places[next(k for k in places if k)]
            places[roads] = one(unpacked(roads, rule))
        return places[roads]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, waiting, seq = state.get if state.exists else (None, None, 0)
        lattice = Lattice.load(rule, zlib.decompress(text).decode() if text else None)
        lattice.nets, lattice.edges = nets, one(lattice.edges)
        fixes, roads = pickle.loads(zlib.decompress(waiting)) if waiting else ([], {})
        mark = state.getCurrentWatermarkMs() / 1000
        if not state.hasTimedOut:
            for b in batches:
                cells = list(zip(b["ci"].tolist(), b["cj"].tolist(), strict=True))
                fixes += [(int(t), float(la), float(lo), c) for t, la, lo, c in zip(b["ts"], b["lat"], b["lon"], cells, strict=True)]
                roads.update({c: zlib.decompress(r) for c, r in dict(zip(cells, b["roads"], strict=True)).items() if r is not None})
        fixes.sort(key=lambda f: f[:3])
        due, rest, rows, before = [f for f in fixes if f[0] < mark], [f for f in fixes if f[0] >= mark], [], None
        for *f, c in due:
            if f[0] != before:
                rows += lattice.push(*f, around(roads.get(c, b"")))
            before = f[0]
        over = not rest and (lattice.seen_ts is None or mark - lattice.seen_ts > rule.gap)
        if over:
            rows += lattice.finish()
            state.remove()
        else:
            seq += 1
            kept = {f[3]: roads[f[3]] for f in rest if f[3] in roads}
            state.update((zlib.compress(lattice.dump().encode(), 1), zlib.compress(pickle.dumps((rest, kept)), 1) if rest else None, seq))
            state.setTimeoutTimestamp(max(int(mark * 1000) + 1, 1000 * (rest[0][0] + 1 if rest else lattice.seen_ts + rule.gap + 1)))
        live = [] if over else lattice.tail()
        out = pd.DataFrame([[key[0], *r, s, seq + over] for part, s in ((rows, True), (live, False)) for r in part], columns=["tr_id", *_COLUMNS, "settled", "seq"])
        if len(out):
            yield out

    placed = stream.where("lat IS NOT NULL AND lon IS NOT NULL").withWatermark("event_time", late)
    ready = with_roads(placed.select("tr_id", F.col("ts").cast("long").alias("ts"), "event_time", "lat", "lon"), nodes, edges, rule, pack=True)
    return ready.groupBy("tr_id").applyInPandasWithState(step, LIVE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def track_now(live: DataFrame) -> DataFrame:
    """Each vehicle's track as known now, from all that match_stream() gave out: the settled head, and the tail of the last call."""
    last = live.groupBy("tr_id").agg(F.max("seq").alias("_last"))
    return live.join(last, "tr_id").where(F.col("settled") | (F.col("seq") == F.col("_last"))).drop("_last")
