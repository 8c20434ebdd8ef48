"""Nearest shapes, exact at any distance: a pyramid of occupied cells bounds where the nearest can be."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import LAT_M, LON_M
from tramline.operators.scan import WHOLE, saved

#: Occupied cells of the coarsest level, at most; every point starts from all of them.
FEW = 16


def lines(vertices: DataFrame, line: str, order: list[str]) -> DataFrame:
    """The segments of lines of vertices (lat, lon) in order: shape_id from 0 along each, with both ends; a line of one vertex is a point."""
    w = Window.partitionBy(line).orderBy(*order)
    ends = vertices.withColumns({"blat": F.lead("lat").over(w), "blon": F.lead("lon").over(w), "shape_id": F.row_number().over(w).cast("long") - 1})
    single = (F.col("shape_id") == 0) & F.col("blat").isNull()
    return ends.where(F.col("blat").isNotNull() | single).select(line, "shape_id", F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.coalesce("blat", "lat").alias("blat"), F.coalesce("blon", "lon").alias("blon"))


def points_as_shapes(places: DataFrame) -> DataFrame:
    """place_id, lat, lon as shapes of one point."""
    return places.select(F.col("place_id").alias("shape_id"), *(F.col(c).alias(e + c) for e in "ab" for c in ("lat", "lon")))


def nearest_shape(points: DataFrame, shapes: DataFrame, lat0: float, own: str | None = None, cutoff_m: float = math.inf, size_m: float = 150.0) -> DataFrame:
    """point_id, shape_id, dist_m and the nearest place (lat, lon) on the nearest segment of each point (point_id, lat, lon).

    With own, only shapes with the point's value in that column count.  Distances
    are planar around lat0; of equal ones, to a micrometre, the smaller shape_id
    is taken.  Without a cutoff every point whose shapes aren't none gets one,
    however far.  A key of WHOLE points and shapes at most is one group, in which
    all distances are taken; the other keys, and all shapes without own, go by the
    pyramid, where points of one place are asked for once.
    """
    keys = [own] if own else []
    scale = LON_M * math.cos(math.radians(lat0))
    metres = {"ax": F.col("alon") * scale, "ay": F.col("alat") * LAT_M, "bx": F.col("blon") * scale, "by": F.col("blat") * LAT_M}
    s = shapes.where("alat IS NOT NULL AND alon IS NOT NULL AND blat IS NOT NULL AND blon IS NOT NULL").select(*keys, "shape_id", *(c.alias(n) for n, c in metres.items()))
    asked = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("point_id", *keys, (F.col("lon") * scale).alias("x"), (F.col("lat") * LAT_M).alias("y"))
    parts = []
    if own:
        s, asked = saved(s.where(F.col(own).isNotNull())), asked.where(F.col(own).isNotNull())
        busy = saved(s.select(own).unionAll(asked.select(own)).groupBy(own).count().where(F.col("count") > WHOLE).select(own))
        few = lambda df: df.join(F.broadcast(busy), own, "left_anti")  # noqa: E731  one row for WHOLE of the input
        parts.append(_within_keys(few(asked), few(s), own))
        s, asked = (df.join(F.broadcast(busy), own, "left_semi") for df in (s, asked))
    if not own or not busy.isEmpty():
        place = [*keys, "x", "y"]
        parts.append(asked.join(_by_pyramid(asked.select(*place).distinct(), s, keys, cutoff_m, size_m), place).select("point_id", "shape_id", "dist_m", "px", "py"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = found.where(F.col("dist_m") <= cutoff_m).groupBy("point_id").agg(F.min(F.struct("dist_m", "shape_id", "px", "py")).alias("b"))
    return best.select("point_id", "b.shape_id", "b.dist_m", (F.col("b.py") / LAT_M).alias("lat"), (F.col("b.px") / scale).alias("lon"))


def _measured(pairs: DataFrame) -> DataFrame:
    """Adds px, py, the place on a segment nearest to x, y, and dist_m to a micrometre."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.least(F.greatest(((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    near = pairs.withColumns({"px": F.col("ax") + t * dx, "py": F.col("ay") + t * dy})
    dist: Column = F.round(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")), 6)
    return near.withColumn("dist_m", dist)


def _within_keys(asked: DataFrame, s: DataFrame, own: str) -> DataFrame:
    """The nearest of its key's shapes for each point; a task takes a key's points by blocks of a million distances."""

    def run(p: pa.Table, t: pa.Table) -> pa.Table:
        t = t.sort_by("shape_id").select(["shape_id", "ax", "ay", "bx", "by"])
        if not len(t):
            p = p.slice(0, 0)
        x, y = (p.column(c).to_numpy()[:, None] for c in ("x", "y"))
        ax, ay, bx, by = (t.column(c).to_numpy() for c in ("ax", "ay", "bx", "by"))
        dx, dy = bx - ax, by - ay
        square, best = np.maximum(dx * dx + dy * dy, 1e-9), np.zeros(len(p), np.int64)
        step = max(1, 1_000_000 // max(1, len(t)))
        for a in range(0, len(p), step):
            u, v = x[a : a + step] - ax, y[a : a + step] - ay
            along = np.clip((u * dx + v * dy) / square, 0, 1)
            best[a : a + step] = np.nan_to_num(np.round(np.hypot(along * dx - u, along * dy - v), 6), nan=np.inf).argmin(axis=1)
        found = t.take(pa.array(best))
        return pa.table({**{c: p.column(c) for c in ("point_id", "x", "y")}, **{c: found.column(c) for c in found.column_names}})

    kind = {f.name: f.dataType.simpleString() for df in (asked, s) for f in df.schema.fields}
    nearest = asked.groupBy(own).cogroup(s.groupBy(own)).applyInArrow(run, ", ".join(f"{c} {kind[c]}" for c in ("point_id", "x", "y", "shape_id", "ax", "ay", "bx", "by")))
    return _measured(nearest).select("point_id", "shape_id", "dist_m", "px", "py")


def _by_pyramid(asked: DataFrame, s: DataFrame, keys: list[str], cutoff_m: float, size_m: float) -> DataFrame:
    """The nearest shape of each place (keys, x, y).

    Shapes are dealt to cells of size_m, and these gathered by fours to a pyramid
    of occupied cells.  From its top a place keeps the cells that can hold something
    nearer than the farthest corner of some occupied one, and looks into their
    fourths; at the bottom it meets the shapes of the few cells that are left.
    """
    place = [*keys, "x", "y"]
    cell = lambda c: F.floor(c / size_m)
    span = lambda a, b: F.sequence(F.least(cell(F.col(a)), cell(F.col(b))), F.greatest(cell(F.col(a)), cell(F.col(b))))
    dealt = saved(s.select("*", F.explode(span("ax", "bx")).alias("ci")).select("*", F.explode(span("ay", "by")).alias("cj")))
    # A cell with a segment's first end surely holds a part of it; others of its box need not.
    sure = (cell(F.col("ax")) == F.col("ci")) & (cell(F.col("ay")) == F.col("cj"))
    levels = [saved(dealt.groupBy(*keys, "ci", "cj").agg(F.max(sure).alias("sure")))]
    while levels[-1].groupBy(*keys).count().agg(F.max("count")).first()[0] not in (None, *range(FEW + 1)):
        up = [F.floor(F.col(c) / 2).alias(c) for c in ("ci", "cj")]
        levels.append(saved(levels[-1].select(*keys, *up, "sure").groupBy(*keys, "ci", "cj").agg(F.max("sure").alias("sure"))))

    def bounded(found: DataFrame, size: float) -> DataFrame:
        """Of each place's cells those that can hold its nearest shape."""
        gap = lambda p, c: F.greatest(F.col(c) * size - F.col(p), F.col(p) - (F.col(c) + 1) * size, F.lit(0.0))
        reach = lambda p, c: F.greatest(F.abs(F.col(p) - F.col(c) * size), F.abs(F.col(p) - (F.col(c) + 1) * size))
        least, most = F.hypot(gap("x", "ci"), gap("y", "cj")), F.hypot(reach("x", "ci"), reach("y", "cj"))
        best = F.min(F.when(F.col("sure"), most)).over(Window.partitionBy(*place))
        kept = found.withColumns({"least": least, "best": F.least(best, F.lit(cutoff_m)) + 1e-3})
        return kept.where(F.col("least") <= F.col("best")).select(*place, "ci", "cj")

    top = len(levels) - 1
    found = asked.join(levels[top], keys) if keys else asked.crossJoin(F.broadcast(levels[top]))  # FEW rows, or so many for each key
    found = bounded(found, size_m * 2**top)
    for k in range(top - 1, -1, -1):
        below = levels[k].select(*(F.col(c).alias(f"s_{c}") for c in keys), F.floor(F.col("ci") / 2).alias("pi"), F.floor(F.col("cj") / 2).alias("pj"), F.col("ci").alias("ki"), F.col("cj").alias("kj"), "sure")
        same = (F.col("ci") == F.col("pi")) & (F.col("cj") == F.col("pj"))
        for c in keys:
            same = same & (F.col(c) == F.col(f"s_{c}"))
        found = found.join(below, same).select(*place, F.col("ki").alias("ci"), F.col("kj").alias("cj"), "sure")
        found = bounded(found, size_m * 2**k)
    near = _measured(found.join(dealt, [*keys, "ci", "cj"]))
    best = near.where(F.col("dist_m") <= cutoff_m).groupBy(*place).agg(F.min(F.struct("dist_m", "shape_id", "px", "py")).alias("b"))
    return best.select(*place, "b.*")
