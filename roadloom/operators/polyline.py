"""Polylines: levels of detail, boxes of stretches, and what a view shows of a route."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions.geo import TILE, mercator_px
from roadloom.operators.chunks import CHUNK, fold_chunks, ordered_chunks
from roadloom.session import large

LEVELS, NEVER, NEAR_PX, LEAF_SPAN = (20, 16, 14, 12, 8, 4, 0), 32, 16.0, 4
_SCALES = [2.0 ** (before - 1) for before in (NEVER, *LEVELS)]
#: Zoom levels of the tiles in which boxes and views meet.
TILE_LEVELS = tuple(range(0, 17, 2))
#: Views that are sent to the boxes, and points of a route that meet its runs together.
SENT_VIEWS, STRETCH = 10_000, 64


class LevelStream:
    """Zoom levels of one polyline's points as they come in order; holds one point a level.

    Both ends show always. Level by level, from fine to coarse, the points that are
    left keep going if the last one kept or the next one left is 16 pixels away or
    more at the finer level. A point's level is known once it drops out, so points leave in another order.
    """

    def __init__(self) -> None:
        self.last: list[tuple | None] = [None] * len(LEVELS)
        self.waiting: list[tuple | None] = [None] * len(LEVELS)
        self.done: list[tuple] = []

    def add(self, point: tuple) -> None:
        """Takes ``(x, y, ...)``; ``done`` gets ``(point, level)``."""
        if self.last[0] is None:
            self.last = [point] * len(LEVELS)
            self.done.append((point, 0))
        else:
            self._arrive(0, point, NEVER)

    def end(self) -> list[tuple]:
        """The points that haven't been taken from ``done``, the polyline's last one with them."""
        final = self.waiting[0]
        if final is not None:
            for k in range(1, len(LEVELS)):
                self._arrive(k, *final)
            self.done.append((final[0], 0))
        return self.done

    def _arrive(self, k: int, point: tuple, level: int) -> None:
        if self.waiting[k] is not None:
            held, before = self.waiting[k]
            last, scale = self.last[k], _SCALES[k]
            near = sqrt((held[0] - last[0]) ** 2 + (held[1] - last[1]) ** 2) * scale < NEAR_PX
            if near and sqrt((held[0] - point[0]) ** 2 + (held[1] - point[1]) ** 2) * scale < NEAR_PX:
                self.done.append((held, before))
            else:
                self.last[k] = held
                if k + 1 < len(LEVELS):
                    self._arrive(k + 1, held, LEVELS[k])
                else:
                    self.done.append((held, LEVELS[k]))
        self.waiting[k] = (point, level)


def zoom_levels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest zoom at which each point of a polyline shows, from pixels at zoom 0."""
    stream, level = LevelStream(), np.full(len(x), NEVER, dtype=np.int32)
    for point in zip(x.tolist(), y.tolist(), range(len(x)), strict=True):
        stream.add(point)
    for point, own in stream.end():
        level[point[2]] = own
    return level


class LevelFold:
    """``LevelStream`` over rows ``(route_id, seq, x, y)``; its state's parts are what each level kept and holds."""

    def __init__(self, state: tuple | None) -> None:
        self.stream = LevelStream()
        if state is not None:
            self.stream.last, self.stream.waiting = list(state[: len(LEVELS)]), list(state[len(LEVELS) :])

    def take(self, rows: list[tuple]) -> list[tuple]:
        for route, seq, x, y in rows:
            self.stream.add((x, y, route, seq))
        return self._done()

    def end(self) -> list[tuple]:
        self.stream.end()
        return self._done()

    def _done(self) -> list[tuple]:
        out = [(p[2], p[3], p[0], p[1], level) for p, level in self.stream.done]
        self.stream.done.clear()
        return out

    def state(self) -> tuple:
        return (*self.stream.last, *self.stream.waiting)


def _level_guess(first: tuple, before: tuple) -> tuple:
    """As if no level had kept a point since the route's first one; the finest holds the last point."""
    first, before = ((x, y, route, seq) for route, seq, x, y in (first, before))
    return (*[first] * len(LEVELS), (before, NEVER), *[None] * (len(LEVELS) - 1))


def polyline_levels(points: DataFrame, chunks: int | None = None) -> DataFrame:
    """``(route_id, seq, x, y, min_zoom)`` of ``points(route_id, seq, lat, lon)``.

    A route may be of any length: it is cut into chunks, each folded by itself (``chunks.fold_chunks``). The fine levels keep points all
    the time, so guesses meet the true fold soon; what the coarse ones keep changes seldom, and passes through chunks.
    """
    x, y = mercator_px(F.col("lon"), F.col("lat"))
    px = ordered_chunks(points.select("route_id", "seq", x.alias("x"), y.alias("y")), "route_id", "seq", chunks=chunks)
    schema = T.StructType([*px.drop(CHUNK).schema.fields, T.StructField("min_zoom", T.IntegerType())])
    return fold_chunks(px, "route_id", ["seq"], LevelFold, schema, ["route_id", "seq", "x", "y"], _level_guess)


def simplify_routes(levels: DataFrame, zoom: Column | int) -> DataFrame:
    """The points that a zoom level shows."""
    return levels.where(F.col("min_zoom") <= zoom)


@cache
def leaf_ranges(n: int) -> list[tuple[int, int]]:
    """Stretches ``(first, last)`` of at most five points, by halving 0..n-1; neighbours share their ends."""
    out, open_ = [], [(0, n - 1)] if n > 0 else []
    while open_:
        first, last = open_.pop()
        if last - first <= LEAF_SPAN:
            out.append((first, last))
        else:
            mid = (first + last) // 2
            open_ += [(mid, last), (first, mid)]
    return out


def route_leaves(points: DataFrame) -> DataFrame:
    """``(route_id, n, leaf_id, first, last)`` for each route's stretches."""
    sizes = points.groupBy("route_id").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, n, i, *span) for r, n in zip(b["route_id"], b["n"], strict=True) for i, span in enumerate(leaf_ranges(int(n)))]
            yield pd.DataFrame(rows, columns=["route_id", "n", "leaf_id", "first", "last"])

    return sizes.mapInPandas(run, "route_id bigint, n bigint, leaf_id bigint, first bigint, last bigint")


_BOX = {"left": ("min", "x"), "right": ("max", "x"), "bottom": ("min", "y"), "top": ("max", "y")}


def bounding_boxes(points: DataFrame) -> DataFrame:
    """``(route_id, leaf_id, first, last, left, right, bottom, top)``: boxes of stretches of ``points(route_id, seq, x, y)``.

    The box covers the stretch; ``first`` and ``last`` reach one point further each way, where there is one.
    """
    leaves = route_leaves(points)
    each = leaves.select("*", F.explode(F.sequence("first", "last")).alias("seq"))
    at = points.select("route_id", F.col("seq").cast("bigint").alias("seq"), "x", "y")
    boxes = each.join(large(at), ["route_id", "seq"]).groupBy("route_id", "leaf_id", "n", "first", "last").agg(
        *(getattr(F, f)(c).alias(k) for k, (f, c) in _BOX.items())
    )
    first, last = F.greatest(F.col("first") - 1, F.lit(0)), F.least(F.col("last") + 1, F.col("n") - 1)
    return boxes.select("route_id", "leaf_id", first.alias("first"), last.alias("last"), *_BOX)


def route_boxes(boxes: DataFrame) -> DataFrame:
    """The union of each route's boxes."""
    return boxes.groupBy("route_id").agg(*(getattr(F, f)(k).alias(k) for k, (f, _) in _BOX.items()))


def view_boxes(viewports: DataFrame) -> DataFrame:
    """Viewports with their box in pixels at zoom 0; pixel rows grow downward, so ``bottom`` is the smaller one."""
    x0, y0 = mercator_px(F.col("lon_left"), F.col("lat_top"))
    x1, y1 = mercator_px(F.col("lon_right"), F.col("lat_bottom"))
    return viewports.select("viewport_id", "zoom", x0.alias("v_left"), x1.alias("v_right"), y0.alias("v_bottom"), y1.alias("v_top"))


def _tile_level(left: str, right: str, bottom: str, top: str) -> Column:
    """The finest level at which the box isn't larger than a tile, so that it touches four at most."""
    span = F.greatest(F.col(right) - F.col(left), F.col(top) - F.col(bottom))
    step = TILE_LEVELS[1] - TILE_LEVELS[0]
    fit = F.floor(F.log2(TILE / span) / step) * step
    return F.when(span <= 0, TILE_LEVELS[-1]).otherwise(F.greatest(F.lit(0), F.least(fit, F.lit(TILE_LEVELS[-1])))).cast("int")


def _tiles(left: str, right: str, bottom: str, top: str, level: str) -> Column:
    scale = F.pow(F.lit(2.0), F.col(level)) / TILE
    axis = lambda a, b: F.sequence(F.floor(F.col(a) * scale), F.floor(F.col(b) * scale))
    return F.explode(F.flatten(F.transform(axis(left, right), lambda i: F.transform(axis(bottom, top), lambda j: F.struct(i.alias("i"), j.alias("j"))))))


def routes_in_viewport(boxes: DataFrame, viewports: DataFrame) -> DataFrame:
    """``(viewport_id, zoom, route_id, leaf_id, first, last, hit)``: stretches whose box meets the view; touching counts.

    Boxes and views meet in tiles, at the coarser of the two levels at which either is no larger than a
    tile: so both lie in a few tiles there, however large a view is. ``hit`` is INCLUSIVE where the box lies in the view, else PARTIAL.
    Up to ``SENT_VIEWS`` views go to the boxes, which stay where they are: a tile that most boxes lie in is no single task's.
    """
    v, b = ("v_left", "v_right", "v_bottom", "v_top"), ("left", "right", "bottom", "top")
    views = view_boxes(viewports).withColumn("v_own", _tile_level(*v))
    # at most as many values as there are levels
    counts = {r.v_own: r["count"] for r in views.groupBy("v_own").count().collect()}
    levels = sorted(own for own in counts if own is not None)
    up_to = lambda own, levels: F.filter(F.array_union(F.array(*(F.lit(x) for x in levels)).cast("array<int>"), F.array(own)), lambda x: x <= F.col(own))
    vt = views.withColumn("level", F.explode(up_to("v_own", TILE_LEVELS))).select("*", _tiles(*v, "level").alias("tile"))
    bt = boxes.withColumn("own", _tile_level(*b))
    bt = bt.withColumn("level", F.explode(up_to("own", levels))).select("*", _tiles(*b, "level").alias("tile"))
    meets = "NOT (right < v_left OR left > v_right OR top < v_bottom OR bottom > v_top)"
    inside = "right <= v_right AND left >= v_left AND top <= v_top AND bottom >= v_bottom"
    hit = F.when(F.expr(inside), "INCLUSIVE").otherwise("PARTIAL").alias("hit")
    sent = F.broadcast(vt) if sum(counts.values()) <= SENT_VIEWS else large(vt)
    rows = bt.join(sent, ["level", "tile"]).where("level = least(own, v_own)").where(meets)
    return rows.select("viewport_id", "zoom", "route_id", "leaf_id", "first", "last", hit).distinct()


def route_runs(hits: DataFrame) -> DataFrame:
    """``(viewport_id, zoom, route_id, run, first, last)``: stretches that follow on each other, drawn as one.

    A new run starts where a stretch begins after all before it have ended.
    """
    w = Window.partitionBy("viewport_id", "route_id").orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("first") > reach), 1).otherwise(0)
    rows = hits.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w))
    return rows.groupBy("viewport_id", "zoom", "route_id", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def drawn_points(runs: DataFrame, levels: DataFrame) -> DataFrame:
    """``(viewport_id, route_id, run, seq, x, y)``: each run's two ends and what its zoom shows between.

    Runs and points meet in stretches of ``STRETCH`` points, so a run is there once a stretch, not once a point.
    """
    at = levels.select("route_id", F.col("seq").cast("bigint").alias("seq"), "x", "y", "min_zoom")
    number = lambda c: F.floor(F.col(c) / STRETCH)
    each = runs.select("*", F.explode(F.sequence(number("first"), number("last"))).alias("stretch"))
    rows = each.join(large(at.withColumn("stretch", number("seq"))), ["route_id", "stretch"]).where(F.col("seq").between(F.col("first"), F.col("last")))
    shown = (F.col("min_zoom") <= F.col("zoom")) | (F.col("seq") == F.col("first")) | (F.col("seq") == F.col("last"))
    return rows.where(shown).select("viewport_id", "route_id", "run", "seq", "x", "y")
