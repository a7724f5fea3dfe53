"""Paths where many are equally long: the same by both methods, and the ones the rule names."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from roadloom.jobs.catalog import QUERIES
from roadloom.operators import graph, validate
from roadloom.sources import fixtures as fx

EDGES = "edge_id long, owner long, direction string, src long, dst long, dist long"
REQUESTS = "request_id long, start_node long, dest_node long"


def plain_path(edges, start, dest):
    """Edge ids from start to destination by the rule: distances first, then the smallest edge that fits, from the end back."""
    dist, heap = {start: 0}, [(0, start)]
    out = {}
    for e, _, _, s, t, w in edges:
        out.setdefault(s, []).append((t, w))
    while heap:
        d, node = heapq.heappop(heap)
        for t, w in out.get(node, ()) if d == dist[node] else ():
            if d + w < dist.get(t, 1 << 60):
                dist[t] = d + w
                heapq.heappush(heap, (d + w, t))
    if dest not in dist:
        return None
    still = {start: 0} | {t: 0 for _, _, _, s, t, w in edges if w and s in dist and dist[s] + w == dist[t]}
    level = set(still)
    while level:
        level = {t for _, _, _, s, t, w in edges if s in level and not w and dist[s] == dist[t] and t not in still}
        still |= {t: 1 + min(still[s] for _, _, _, s, x, w in edges if x == t and not w and s in still and dist[s] == dist[t]) for t in level}
    path, at = [], dest
    while at != start:
        e, s = min((e, s) for e, _, _, s, t, w in edges if t == at and s in dist and dist[s] + w == dist[at] and still[at] == (0 if w else still[s] + 1))
        path.append(e)
        at = s
    return path[::-1]


@pytest.mark.parametrize(("seed", "least"), [(1, 1), (2, 1), (3, 0), (4, 0), (5, 0)])
def test_ties_are_settled_alike(spark, seed, least):
    """Weights of 1 and 2, or 0 to 2, over a dense graph, given in any order of rows."""
    r = random.Random(seed)
    raw = [(e, s := r.randrange(14), "out", s, r.randrange(14), r.randrange(least, 3)) for e in r.sample(range(200), 70)]
    asked = [(i, r.randrange(14), r.randrange(14)) for i in range(40)]
    edges, requests = spark.createDataFrame(raw, EDGES).repartition(3), spark.createDataFrame(asked, REQUESTS)
    want = {q: p for q, s, t in asked if (p := plain_path(raw, s, t)) is not None}
    by_rounds = graph.shortest_paths_by_rounds(requests, None, edges)
    for labels in (*(graph.shortest_paths(requests, None, edges, core_limit=n) for n in (graph.CORE_LIMIT, 0)), by_rounds):
        rows = graph.backtrack(requests, labels).orderBy("request_id", "seq").collect()
        got = {q: [] for q in {x.request_id for x in rows}}
        for x in rows:
            if x.edge_id is not None:
                got[x.request_id].append(x.edge_id)
        assert got == want


def test_edges_of_weight_0_by_hand(spark):
    """Two ways of the same length, one over an edge of weight 0: the limit of the core changes nothing."""
    raw = [(1, 1, "out", 1, 2, 1), (9, 2, "out", 2, 3, 0), (2, 1, "out", 1, 4, 1), (3, 4, "out", 4, 3, 0), (10, 3, "out", 3, 5, 1)]
    requests = spark.createDataFrame([(0, 1, 5)], REQUESTS)
    for limit in (graph.CORE_LIMIT, 1, 0):
        labels = graph.shortest_paths(requests, None, spark.createDataFrame(raw, EDGES), core_limit=limit)
        path = graph.backtrack(requests, labels).orderBy("seq").collect()
        assert [x.edge_id for x in path] == [None, 2, 3, 10]


def test_general_graph_by_brute_force(spark, sf):
    edges = [tuple(r) for r in fx.general_edges(spark, sf).select("edge_id", "owner", "direction", "src", "dst", "dist").collect()]
    weight = {e[0]: e[5] for e in edges}
    asked = fx.route_requests(spark, sf).collect()
    got = {r.request_id: r.dist for r in QUERIES["g4_general_graph"](spark, sf).collect()}
    want = {}
    for r in asked[::7]:
        path = plain_path(edges, r.start_node, r.dest_node)
        if path is not None:
            want[r.request_id] = sum(weight[e] for e in path)
    assert want == {q: got[q] for q in want}
    assert len(got) <= len(asked) and set(got) <= {r.request_id for r in asked}


def test_hierarchy_by_both_methods(spark, sf):
    """Cones and core: a core that is sent and one that isn't give the same paths."""
    nodes, edges = fx.nodes(spark, sf), fx.edges(spark, sf)
    requests = fx.route_requests(spark, sf).limit(60)
    both = graph.cones(requests.select(F.col("start_node").alias("root")), requests.select(F.col("dest_node").alias("root")), edges, nodes)
    core = graph.core_edges(edges, nodes)
    found = [graph.shortest_paths(requests, both, core, core_limit=n) for n in (graph.CORE_LIMIT, 0)]
    up, down = (both.where(F.col("direction") == d) for d in ("out", "in"))
    found.append(graph.shortest_paths_by_rounds(requests, graph.search_graph(requests, up, down), core))
    a, b, c = ({(r.request_id, r.seq, r.node_id, r.edge_id) for r in graph.backtrack(requests, labels).collect()} for labels in found)
    assert a == b == c and len({x[0] for x in a}) == requests.count()


def test_large_core_of_a_grid(spark, sf):
    """Every node is core and most paths are tied: only edges on shortest paths are taken along, and searches are one a start."""
    requests, edges = fx.grid_requests(spark, sf).limit(120), fx.grid_edges(spark, sf)
    paths = [graph.shortest_paths(requests, None, edges, core_limit=n).collect() for n in (graph.CORE_LIMIT, 5)]
    assert sorted(paths[0]) == sorted(paths[1]) and paths[0]
    dist = {(r.request_id): r.dist for r in paths[0] if r.seq == max(x.seq for x in paths[0] if x.request_id == r.request_id)}
    ways = {(r.start_node, r.dest_node): r.core for r in graph.core_ways(requests, None, edges).collect()}
    w = fx.grid_size(spark, sf)[0]
    for r in requests.collect():
        own = ways.get((r.start_node, r.dest_node), [])
        high, wide = abs(r.start_node // w - r.dest_node // w), abs(r.start_node % w - r.dest_node % w)
        assert len(own) == high * (wide + 1) + wide * (high + 1) and dist[r.request_id] == 7 * (high + wide)


def test_ends_without_a_way(spark):
    edges = spark.createDataFrame([(1, 1, "out", 1, 2, 5), (2, 2, "out", 2, 1, 0)], EDGES)
    requests = spark.createDataFrame([(0, 1, 2), (1, 2, 9), (2, 9, 9), (3, 1, 1), (4, None, 1), (5, 1, None), (6, 1, 2)], REQUESTS)
    for e in (edges, edges.where("FALSE")):
        found = [sorted(map(repr, graph.shortest_paths(requests, None, e, core_limit=n).where("request_id NOT IN (4, 5)").collect())) for n in (graph.CORE_LIMIT, 0)]
        assert found[0] == found[1]
    assert len(found[0]) == 2


def test_broken_ranges(spark):
    rows = [(0, 0, 2, 3), (1, 3, 3, 4), (2, 3, 5, 6), (1024, 7, 6, 8), (1025, 8, 9, 9)]
    ranges = spark.createDataFrame(rows, "owner long, out_start long, in_start long, end long")
    found = {tuple(r) for r in validate.validate_ranges(ranges, 3, 9).collect()}
    assert found == {("range_overlap", 1), ("range_backward", 1024)}
    assert {tuple(r) for r in validate.validate_ranges(ranges, 3, 10).collect()} - found == {("last_offset", 9)}
    assert ("range_overlap", 2) in {tuple(r) for r in validate.validate_ranges(spark.createDataFrame([(2, 0, 1, 5), (1024, 4, 6, 6)], ranges.schema), 3, 6).collect()}


def test_numbers_and_slots(spark):
    nodes = spark.createDataFrame([(0, False), (5, False), (2048, True)], "node_id long, is_core boolean")
    edges = spark.createDataFrame([(0, 0, "out", 0, 5, 1), (7, 5, "out", 5, 0, 1), (1, 2048, "in", 0, 2048, 1)], EDGES)
    details = spark.createDataFrame([(e, 1, -1, -1, -1) for e in (0, 1, 7)], "edge_id long, euclid long, shortcut1 long, shortcut2 long, shortcut_node long")
    found = {tuple(r) for r in validate.validate_graph(nodes, edges, details, block_size=4, block_count=2).collect()}
    assert found == {("core_in_list", 1), ("edge_number", 7), ("slot_number", 5), ("block_number", 2048)}
