"""One device or route over many tasks: chunks give what one fold over all rows gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from roadloom.operators import chunks, polyline, tracking


def _kept(rows, improve_only=False):
    last, out = {}, []
    for e, d, ts, acc, *_ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if tracking.keep_fix(ts, acc, *last.get(d, (None, None)), improve_only):
            last[d] = (ts, acc)
            out.append(e)
    return sorted(out)


def _fixes(r, n, device, step):
    ts, out = 0, []
    for i in range(n):
        ts += r.choice(step)
        out.append((i, device(i), ts, float(r.randrange(0, 40)), 48.0, 9.0))
    return out


@pytest.mark.parametrize(
    ("device", "step"),
    [
        (lambda i: 7, (0, 500, 1000, 4000)),  # one device, never a gap
        (lambda i: 7, (1000, 30_000)),
        (lambda i: 7, (0,)),  # all at the same time
        (lambda i: i % 3, (0, 700)),
        (lambda i: 7 if i % 3 else i, (0, 700)),  # a third of all devices have one fix
    ],
)
def test_a_track_over_many_chunks(spark, device, step):
    rows = _fixes(random.Random(1), 3000, device, step)
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, device_id long, ts_ms long, accuracy double, lat double, lon double")
    for improve_only in (False, True):
        got = tracking.filter_gps(df, improve_only, chunks=23)
        assert sorted(r.event_id for r in got.collect()) == _kept(rows, improve_only)


def test_one_device_runs_in_many_tasks(spark):
    rows = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("device_id"), (F.col("id") * 300).alias("ts_ms"), (F.col("id") * 7 % 23).cast("double").alias("accuracy"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"))
    sizes = [r["count"] for r in chunks.ordered_chunks(rows, "device_id", "ts_ms", "event_id", chunks=16).groupBy(chunks.CHUNK).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16


def _route(kind, n):
    r = np.random.default_rng(4)
    if kind == "wide":
        steps = r.normal(0, 0.3, (n, 2))
    elif kind == "town":  # no coarse level keeps a point but the ends
        steps = r.normal(0, 1e-5, (n, 2))
    else:  # still for long, then far away
        steps = np.where(np.arange(n)[:, None] % 700 == 699, r.normal(0, 20, (n, 2)), r.normal(0, 1e-4, (n, 2)))
    at = np.cumsum(steps, axis=0)
    return np.clip(at[:, 0], -80, 80), np.clip(at[:, 1], -170, 170)


@pytest.mark.parametrize("kind", ["wide", "town", "leaps"])
def test_a_route_over_many_chunks(spark, kind, monkeypatch):
    lat, lon = _route(kind, 4000)
    rows = [(5, i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))] + [(1, 0, 10.0, 10.0), (2, 0, 1.0, 1.0), (2, 1, 1.0, 2.0), (9, 3, 0.0, 0.0)]
    random.Random(3).shuffle(rows)
    rounds = []
    exits = chunks._exits
    monkeypatch.setattr(chunks, "_exits", lambda *a: rounds.append(len(a[-1])) or exits(*a))
    got = polyline.polyline_levels(spark.createDataFrame(rows, "route_id long, seq int, lat double, lon double"), chunks=25).collect()
    assert len(got) == len(rows) and sorted((r.route_id, r.seq) for r in got) == sorted(r[:2] for r in rows)
    own = sorted((r for r in got if r.route_id == 5), key=lambda r: r.seq)
    want = polyline.zoom_levels(np.array([r.x for r in own]), np.array([r.y for r in own]))
    assert [r.min_zoom for r in own] == want.tolist()
    assert all(r.min_zoom == 0 for r in got if r.route_id != 5)
    assert len(rounds) <= 6, rounds


def test_guesses_only_cost_rounds(spark, monkeypatch):
    """A guess that is always wrong gives the same rows."""
    lat, lon = _route("leaps", 1500)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "route_id long, seq int, lat double, lon double")
    want = {(r.seq, r.min_zoom) for r in polyline.polyline_levels(df, chunks=1).collect()}
    monkeypatch.setattr(polyline, "_level_guess", lambda first, before: (*[(0.0, 0.0, 1, -1)] * 7, *[None] * 7))
    assert {(r.seq, r.min_zoom) for r in polyline.polyline_levels(df, chunks=12).collect()} == want


def test_tables_without_rows(spark):
    fixes = spark.createDataFrame([], "event_id long, device_id long, ts_ms long, accuracy double, lat double, lon double")
    assert tracking.filter_gps(fixes).count() == 0
    points = spark.createDataFrame([], "route_id long, seq int, lat double, lon double")
    assert polyline.polyline_levels(points).count() == 0
