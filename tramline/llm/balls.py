"""Centroid clustering by ball-tree filtering: k-means in integers, exact.

Each batch of a partition becomes a metric tree, whose balls store their
radius, number and integer sum.  A round passes the trees: where the triangle
inequality shows that one centroid is nearest to all of a ball, its number and
sum count as a whole; otherwise its halves are looked at, and the vectors of a
leaf one by one.  Only `k` centroids and their sums ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.graph import Scratch

#: Components beyond this are taken as this, so that squared distances of 64 components fit in a long.
LARGEST = 1 << 27
#: What roots of exact integers may be wrong by, and more, relative to their size.
_SLACK = 1e-9
_TREE = "dim int, members binary, ids binary, nulls binary, lefts binary, rights binary, starts binary, ends binary, pivots binary, radii binary, sums binary"


def _quantised(batches: Iterator[pa.RecordBatch], dim: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, which of them are null, and integer vectors of the kept rows of each batch."""
    for batch in batches:
        lists = batch.column("embedding")
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
        at = np.flatnonzero(sizes == dim)
        if not len(at):
            continue
        some = lists.take(pa.array(at))
        x = some.flatten().cast(pa.float64())
        x = np.asarray(pc.fill_null(x, float("nan"))).reshape(len(at), dim)
        good = np.isfinite(x).all(axis=1)
        v = np.clip(np.floor(np.clip(x[good] * scale, -2.0 * LARGEST, 2.0 * LARGEST)), -LARGEST, LARGEST).astype(np.int64)
        ids = batch.column("vec_id").take(pa.array(at[good]))
        yield np.asarray(pc.fill_null(ids, 0)).astype(np.int64), np.asarray(pc.is_null(ids)), v


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Tree:
    """A metric tree over the rows of v: balls as arrays, `order` of the rows so that each ball is a range of it."""

    def __init__(self, v: np.ndarray, leaf: int = 16) -> None:
        self.order = np.arange(len(v))
        self.left: list[int] = []
        self.right: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.pivot: list[np.ndarray] = []
        self.radius: list[float] = []
        self.sum: list[np.ndarray] = []
        todo = [(0, len(v), -1)]
        while todo:
            a, b, parent = todo.pop()
            rows = v[self.order[a:b]]
            total = rows.sum(axis=0)
            pivot = total // (b - a)
            far = _squared(rows, pivot)
            number = len(self.left)
            if parent >= 0:  # the right half is made first
                if self.right[parent] < 0:
                    self.right[parent] = number
                else:
                    self.left[parent] = number
            self.left.append(-1)
            self.right.append(-1)
            self.start.append(a)
            self.end.append(b)
            self.pivot.append(pivot)
            self.radius.append(float(np.sqrt(far.max())) * (1 + _SLACK))
            self.sum.append(total)
            one = rows[int(far.argmax())]
            other = rows[int(_squared(rows, one).argmax())]
            if b - a <= leaf or np.array_equal(one, other):  # few rows, or all are equal
                continue
            near = _squared(rows, one) < _squared(rows, other)
            part = self.order[a:b]
            self.order[a:b] = np.concatenate([part[near], part[~near]])
            mid = a + int(near.sum())
            todo += [(a, mid, number), (mid, b, number)]


def _trees(batches: Iterator[pa.RecordBatch], dim: int, scale: float, most: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _TREE.split(", ")]
    for ids, nulls, v in _quantised(batches, dim, scale):
        for a in range(0, len(v), most):
            part = v[a : a + most]
            if not len(part):
                continue
            t = Tree(part)
            i32 = lambda x: np.array(x, np.int32).tobytes()
            row = [
                dim, part[t.order].astype(np.int32).tobytes(), ids[a : a + most][t.order].tobytes(), nulls[a : a + most][t.order].tobytes(), i32(t.left), i32(t.right), i32(t.start), i32(t.end),
                np.array(t.pivot).tobytes(), np.array(t.radius).tobytes(), np.array(t.sum).tobytes(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], names=names)


def assigned(row: dict, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """Parts of a tree as (first member, end, cluster, sum of the ball), or with the clusters of its members and no sum.

    Equal distances go to the smaller number.  A ball is taken as a whole only if
    the bound holds by more than roots may be wrong by, so the result is exact.
    """
    dim = row["dim"]
    members = np.frombuffer(row["members"], np.int32).reshape(-1, dim)
    left, right, start, end = (np.frombuffer(row[c], np.int32) for c in ("lefts", "rights", "starts", "ends"))
    pivots, sums = (np.frombuffer(row[c], np.int64).reshape(-1, dim) for c in ("pivots", "sums"))
    radii = np.frombuffer(row["radii"], np.float64)
    level = np.zeros(1, np.int64)
    while len(level):
        away = np.sqrt(np.stack([_squared(pivots[level], c) for c in centroids], axis=1).astype(float))
        best = away.argmin(axis=1)
        nearest = away[np.arange(len(level)), best]
        away[np.arange(len(level)), best] = np.inf
        second = away.min(axis=1)
        whole = nearest * (1 + _SLACK) + 2 * radii[level] < second * (1 - _SLACK)
        for b, c in zip(level[whole].tolist(), best[whole].tolist(), strict=True):
            yield int(start[b]), int(end[b]), c, sums[b]
        open_ = level[~whole]
        leaf = left[open_] < 0
        for b in open_[leaf].tolist():
            own = members[start[b] : end[b]].astype(np.int64)
            yield int(start[b]), int(end[b]), np.stack([_squared(own, c) for c in centroids], axis=1).argmin(axis=1), None
        level = np.concatenate([left[open_[~leaf]], right[open_[~leaf]]]).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _sums(centroids: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for row in _rows(batches):
            dim = row["dim"]
            members = np.frombuffer(row["members"], np.int32).reshape(-1, dim)
            for a, b, cluster, ball in assigned(row, centroids):
                if ball is not None:
                    total[cluster] += ball
                    number[cluster] += b - a
                else:
                    np.add.at(total, cluster, members[a:b].astype(np.int64))
                    number += np.bincount(cluster, minlength=len(centroids))
        k, dim = centroids.shape
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), k)), pa.array(total.ravel()), pa.array(np.repeat(number, dim))], names=["cluster", "at", "total", "number"])

    return run


def _members(centroids: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            members = np.frombuffer(row["members"], np.int32).reshape(-1, row["dim"]).astype(np.int64)
            cluster = np.zeros(len(members), np.int64)
            for a, b, c, _ in assigned(row, centroids):
                cluster[a:b] = c
            ids, nulls = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(cluster.astype(np.int32)), pa.array(_squared(members, centroids[cluster]))], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 2048) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, and the centroids after the last round.

    Vectors with exactly `dim` components, all finite, are kept, each component x as
    the integer floor(scale * x); integers beyond LARGEST are taken as LARGEST.
    Centroids start as the k kept vectors with an id and the smallest SHA-256 of
    `1:<vec_id>`; of rows with the same id the one with the smaller vector comes
    first.  With fewer than k such rows there are as many centroids, with none no
    row comes back.  Kept rows without an id are assigned like others, repeated
    rows each.  Further columns are not read.
    """
    spark = vectors.sparkSession
    work = Scratch(spark)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    valid = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(2.0 * LARGEST)), F.lit(-2.0 * LARGEST))), F.lit(LARGEST)), F.lit(-LARGEST)))
    seeds = given.where(valid & F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), whole.alias("v")).orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in sorted(seeds, key=lambda r: (r["h"], r["v"]))], np.int64).reshape(-1, dim)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    trees = work.keep(given.mapInArrow(lambda it: _trees(it, dim, scale, most), _TREE))
    for _ in range(rounds):
        parts = trees.mapInArrow(_sums(centroids), "cluster int, at int, total long, number long")
        sums = parts.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("number").alias("number")).collect()  # k * dim rows
        moved = centroids.copy()
        for r in sums:
            if r["number"]:
                moved[r["cluster"], r["at"]] = r["total"] // r["number"]
        centroids = moved
    return trees.mapInArrow(_members(centroids), "vec_id long, cluster int, distance long"), centroids.tolist()


def summary(assignment: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assignment with cluster_inertia, inertia and the SHA-256 of each cluster's final centroid."""
    spark = assignment.sparkSession
    kept = Scratch(spark).keep(assignment)
    each = kept.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row per cluster
    names = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids)], "cluster int, text string")
    found = each.crossJoin(each.agg(F.sum("cluster_inertia").alias("inertia"))).join(names, "cluster")  # one row on the right
    return kept.join(F.broadcast(found.select("cluster", "cluster_inertia", "inertia", F.sha2("text", 256).alias("centroid_sha256"))), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
