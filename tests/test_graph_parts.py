"""Graph tables at rest that joins read in place, and routes of which only a part is unpacked."""

import random

import pytest
from pyspark.sql import functions as F

from roadloom.operators import graph
from roadloom.session import cut
from roadloom.sources import fixtures as fx
from roadloom.sources import graph_file
from roadloom.sources.graph_file import load_graph_tables, write_graph_tables

PARTS = "part_id long, request_id long, first long, last long, west int, east int, south int, north int"
PATH = "request_id long, seq long, node_id long, edge_id long"


@pytest.fixture(scope="module")
def roads(spark, sf):
    return {"nodes": cut(fx.nodes(spark, sf)), "edges": cut(fx.edges(spark, sf)), "edge_details": cut(fx.edge_details(spark, sf))}


@pytest.fixture()
def joins_that_sort(spark):
    """Plans without broadcasts, nor filters that scan a table beforehand."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def exchanges_over(df, table):
    """Exchanges between the scan of ``table`` and the join that it feeds."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    start = lambda line: next((i for i, c in enumerate(line) if c.isalpha()), 0)
    (at,) = (i for i, x in enumerate(lines) if "FileScan parquet" in x and f"_{table}[" in x and "Bucketed: true" in x)
    depth, found = start(lines[at]), 0
    for line in reversed(lines[:at]):
        if start(line) < depth:
            depth = start(line)
            if "Join" in line:
                return found
            found += "Exchange" in line
    raise AssertionError("no join")


@pytest.mark.parametrize("buckets", [4, 7])
def test_cones_move_no_edges(spark, sf, roads, tmp_path, joins_that_sort, buckets):
    folder = str(tmp_path / "graph")
    write_graph_tables(roads, folder, buckets)
    stored = load_graph_tables(spark, folder)
    requests = fx.route_requests(spark, sf)
    starts, dests = (requests.select(F.col(c).alias("root")) for c in ("start_node", "dest_node"))
    got = graph.cones(starts, dests, stored["edges"], stored["nodes"], laid_out=True)
    want = graph.cones(starts, dests, roads["edges"], roads["nodes"])
    rows = lambda df: sorted(map(tuple, df.select(want.columns).collect()))
    assert rows(got) == rows(want)
    assert exchanges_over(got, "edges") == 0
    # halving a shortcut reads details in place too
    asked = spark.range(50).select(F.col("id").alias("part"), F.lit(1).alias("n"))
    step = asked.join(stored["edge_details"].select(F.col("edge_id").alias("part"), "shortcut1"), "part")
    assert exchanges_over(step, "edge_details") == 0


def test_another_session_learns_the_layout(spark, roads, tmp_path):
    folder = str(tmp_path / "graph")
    write_graph_tables(roads, folder, 3)
    here = {t: sorted(map(tuple, df.collect())) for t, df in load_graph_tables(spark, folder).items()}
    for t in roads:
        spark.sql(f"DROP TABLE {graph_file._table_name(folder, t)}")
    again = load_graph_tables(spark, folder)
    assert {t: sorted(map(tuple, df.collect())) for t, df in again.items()} == here
    for t in roads:
        told = spark.sql(f"DESCRIBE EXTENDED {graph_file._table_name(folder, t)}").where("col_name = 'Num Buckets'").first()[1]
        assert told == "3"
    empty = {t: df.where("FALSE") for t, df in roads.items()}
    write_graph_tables(empty, str(tmp_path / "none"), 2)
    assert all(df.count() == 0 for df in load_graph_tables(spark, str(tmp_path / "none")).values())
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        write_graph_tables(roads, folder, 3)


def test_parts_equal_the_whole(spark, sf, roads):
    r = random.Random(1)
    requests = cut(fx.route_requests(spark, sf).limit(80))
    both = graph.cones(*(requests.select(F.col(c).alias("root")) for c in ("start_node", "dest_node")), roads["edges"], roads["nodes"])
    path = cut(graph.backtrack(requests, graph.shortest_paths(requests, both, graph.core_edges(roads["edges"], roads["nodes"]))))
    extents = cut(graph.leaf_extents(roads["edges"], roads["nodes"], roads["edge_details"]))
    assert extents.count() == roads["edges"].count()
    whole = graph.unpack_shortcuts(path, roads["edges"], roads["edge_details"]).collect()
    place = {n.node_id: (n.lon_e7, n.lat_e7) for n in roads["nodes"].collect()}
    ids = sorted({x.request_id for x in whole})
    draw = lambda low, high, none: None if r.random() < none else r.randrange(low, high)
    parts = [(i, r.choice(ids), draw(0, 60, 0.4), draw(0, 60, 0.4), *(draw(*b, 0.5) for b in ((60_000_000, 150_000_000),) * 2), *(draw(*b, 0.5) for b in ((470_000_000, 550_000_000),) * 2)) for i in range(200)]
    parts += [(-1, ids[0], None, None, None, None, None, None), (-2, -77, 0, 9, None, None, None, None), (-1, ids[0], None, None, None, None, None, None)]
    want = []
    for number, request, first, last, west, east, south, north in parts:
        for x in whole:
            lon, lat = place[x.node_id]
            bounds = [(x.seq, first, last), (lon, west, east), (lat, south, north)]
            if x.request_id == request and all((a is None or a <= v) and (b is None or v <= b) for v, a, b in bounds):
                want.append((number, request, x.seq, x.node_id))
    got = graph.unpack_parts(path, spark.createDataFrame(parts, PARTS), extents, roads["nodes"])
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_the_rest_is_not_opened(spark):
    """A route of one shortcut over 64 roads: what lies beside the stretch may be missing from the table."""
    edges, details, below = [], [], {}
    level = [(i, i, i + 1) for i in range(64)]
    edges += [(e, a, "out", a, b, 1) for e, a, b in level]
    details += [(e, 10, -1, -1, -1) for e, _, _ in level]
    number = 1000
    while len(level) > 1:
        up = []
        for (e, a, m), (f, _, b) in zip(level[::2], level[1::2], strict=True):
            edges.append((number, a, "out", a, b, b - a))
            details.append((number, 10 * (b - a), e, f, m))
            below[number] = (e, f)
            up.append((number, a, b))
            number += 1
        level = up
    top = level[0][0]
    schema = "edge_id long, owner long, direction string, src long, dst long, dist long"
    nodes = spark.createDataFrame([(i, i, -i, False) for i in range(65)], "node_id long, lon_e7 int, lat_e7 int, is_core boolean")
    broken = [(5000, 1, 5000, 5000, 1), (5001, 1, 77_777, 3, 1)]
    table = spark.createDataFrame(details + broken, "edge_id long, euclid long, shortcut1 long, shortcut2 long, shortcut_node long")
    ways = spark.createDataFrame(edges + [(e, 0, "out", 0, 1, 1) for e, *_ in broken], schema)
    extents = cut(graph.leaf_extents(ways, nodes, table))
    known = {x.edge_id: (x.leaves, x.euclid, x.west, x.east, x.south, x.north) for x in extents.collect()}
    assert known[top] == (64, 640, 1, 64, -64, -1) and not known.keys() & {5000, 5001}
    path = spark.createDataFrame([(1, 0, 0, None), (1, 1, 64, top), (2, 0, 5, None), (2, 1, 6, 5), (2, 2, 7, 5000), (2, 3, 8, 7)], PATH)
    # from the top down, the shortcuts that hold roads 20 to 22, and the sibling of each, whose size alone is asked
    need, todo = set(), [(top, 0, 64)]
    while todo:
        e, at, n = todo.pop()
        need.add(e)
        if n > 1 and at <= 22 and at + n > 20:
            todo += [(below[e][0], at, n // 2), (below[e][1], at + n // 2, n // 2)]
    few = cut(extents.where(F.col("edge_id").isin(sorted(need))))
    assert few.count() < 25 < extents.count()
    parts = spark.createDataFrame([(7, 1, 21, 23, None, None, None, None)], PARTS)
    assert sorted(map(tuple, graph.unpack_parts(path, parts, few, nodes).collect())) == [(7, 1, s, s) for s in (21, 22, 23)]
    # a box does the same, and a route ends before an edge that isn't known
    parts = spark.createDataFrame([(8, 1, None, None, 21, 23, None, None), (9, 2, None, None, None, None, None, None), (10, 1, 0, 0, None, None, None, None)], PARTS)
    got = graph.unpack_parts(path, parts, extents, nodes)
    assert sorted(map(tuple, got.collect())) == [(8, 1, s, s) for s in (21, 22, 23)] + [(9, 2, 0, 5), (9, 2, 1, 6), (10, 1, 0, 0)]
    assert graph.unpack_parts(path.where("FALSE"), parts, extents, nodes).count() == 0
    assert graph.leaf_extents(ways.where("FALSE"), nodes, table).count() == 0
