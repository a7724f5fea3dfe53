"""Views, runs and points of routes meet without a task that gets most of them."""

from __future__ import annotations

from roadloom.jobs import catalog
from roadloom.operators import polyline


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_runs_meet_points_in_stretches(spark):
    points = [(r, s, float(s), float(r), s % 21) for r, n in ((1, 300), (2, 64), (3, 1)) for s in range(n)]
    levels = spark.createDataFrame(points, "route_id bigint, seq int, x double, y double, min_zoom int")
    runs = [(1, 4, 1, 1, 0, 70), (1, 4, 1, 2, 127, 128), (2, 16, 1, 1, 63, 299), (2, 16, 2, 1, 0, 63), (3, 0, 3, 1, 0, 0)]
    got = polyline.drawn_points(spark.createDataFrame(runs, "viewport_id bigint, zoom int, route_id bigint, run bigint, first bigint, last bigint"), levels)
    want = [(v, r, k, s, x, y) for v, z, r, k, a, b in runs for q, s, x, y, m in points if q == r and a <= s <= b and (m <= z or s in (a, b))]
    assert rows(got) == sorted(want)
    # a run of 237 points lies in 4 stretches or 5; before, every point was a row
    assert "stretch" in plan(got)
    assert "Broadcast" not in plan(got)


def test_boxes_stay_where_they_are(spark, sf, monkeypatch):
    boxes, views = polyline.bounding_boxes(catalog._pixels(spark, sf)), catalog.fx.viewports(spark, sf)
    assert "Broadcast" not in plan(boxes)
    sent = polyline.routes_in_viewport(boxes, views)
    monkeypatch.setattr(polyline, "SENT_VIEWS", 0)
    merged = polyline.routes_in_viewport(boxes, views)
    assert "BroadcastHashJoin" in plan(sent)
    assert "BroadcastHashJoin" not in plan(merged)
    assert rows(sent) == rows(merged)
