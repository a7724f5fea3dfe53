"""Every registered query against the same result in DuckDB SQL."""

from pathlib import Path

import duckdb
import pytest

from roadloom.jobs.catalog import ORACLES, QUERIES


def compare(spark, sf, query, sql):
    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want, got = db.sql(sql).df(), query(spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    want, got = (x[columns].sort_values(columns).reset_index(drop=True).astype(object) for x in (want, got))
    assert len(want) == len(got)
    for c in columns:
        assert (want[c].where(want[c].notna(), None) == got[c].where(got[c].notna(), None)).mask(want[c].isna() & got[c].isna(), True).all(), c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLES[name])


def test_levels_keep_both_ends(spark, sf):
    rows = QUERIES["h2_polyline_levels"](spark, sf).toPandas()
    for _, route in rows.groupby("route_id"):
        ends = route[route["seq"].isin([0, route["seq"].max()])]
        assert (ends["min_zoom"] == 0).all()
    assert set(rows["min_zoom"]) <= {0, 4, 8, 12, 14, 16, 20, 32}


def test_drawn_points_have_their_runs_ends(spark, sf):
    rows = QUERIES["w6_drawn_points"](spark, sf).toPandas()
    runs = QUERIES["w6_route_runs"](spark, sf).toPandas()
    seen = rows.groupby(["viewport_id", "route_id", "run"])["seq"].agg(["min", "max"]).reset_index()
    both = runs.merge(seen, on=["viewport_id", "route_id", "run"])
    assert len(both) == len(runs) and (both["first"] == both["min"]).all() and (both["last"] == both["max"]).all()
