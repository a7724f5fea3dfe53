"""One registered query for each operator of the library, with the same result in DuckDB SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo, text
from roadloom.functions.requests import choose_start, routable_requests, settled_only
from roadloom.jobs import routing
from roadloom.jobs.route_store import find_routes_once, graph_version
from roadloom.operators import graph, polyline, report, search, sessions, snap, tracking, validate
from roadloom.session import cut, large, shared_folder, table
from roadloom.sources import fixtures as fx
from roadloom.sources.graph_file import load_graph_tables, read_graph_file, write_graph_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _cell_sql(v: str, base: int, count: int) -> str:
    return f"greatest(0, least({count - 1}, CAST(trunc(({v} - {base}) / 1000000) AS BIGINT)))"


@query(
    "p1_p2_p3_node_keys",
    fx.with_tables("points")
    + f"""SELECT point_id, point_id // 1024 AS block, point_id % 1024 AS idx, point_id // 1024 >= 1 AS core,
  CAST({_cell_sql('lat_e7', 470000000, 81)} * 91 + {_cell_sql('lon_e7', 60000000, 91)} AS INTEGER) AS cell_id FROM points""",
)
def node_keys(spark: SparkSession, sf: str) -> DataFrame:
    block, idx = geo.split_node_id(F.col("point_id"))
    cell = geo.grid_cell(F.col("lon_e7"), F.col("lat_e7"), fx.GRID)
    return fx.query_points(spark, sf).select("point_id", block.alias("block"), idx.alias("idx"), geo.is_core(F.col("point_id"), 1).alias("core"), cell.alias("cell_id"))


@query(
    "p4_edge_endpoints",
    fx.with_tables("size", "road", "hierarchy", "edges") + "SELECT edge_id, src, dst FROM edges",
)
def edge_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    peer = F.when(F.col("owner") == F.col("src"), F.col("dst")).otherwise(F.col("src"))
    stored = fx.edges(spark, sf).select("edge_id", "owner", "direction", peer.alias("peer"), "dist")
    return graph.edge_endpoints(stored).select("edge_id", "src", "dst")


@query(
    "p5_p6_positioned_in_rect",
    fx.with_tables("items") + "SELECT item_id FROM items WHERE placed AND len(strs) > 0 AND lat BETWEEN 48.0 AND 52.5 AND lon BETWEEN 6.0 AND 11.0",
)
def positioned_in_rect(spark: SparkSession, sf: str) -> DataFrame:
    at = search.item_position(search.positioned_items(fx.items(spark, sf)))
    box = geo.in_geo_rect(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(52.5), F.lit(6.0), F.lit(11.0))
    return at.where(box).select("item_id")


@query(
    "p7_p8_routable_requests",
    fx.with_tables("size", "nodes", "fixes", "sessions")
    + """SELECT event_id, s.lat_e7 AS start_lat, s.lon_e7 AS start_lon, end_at.lat_e7 AS end_lat FROM (
  SELECT event_id, end_at, CASE WHEN follow_gps THEN coalesce(gps, start_at) ELSE coalesce(start_at, gps) END AS s FROM sessions)
WHERE s IS NOT NULL AND end_at IS NOT NULL""",
)
def routable(spark: SparkSession, sf: str) -> DataFrame:
    start = choose_start(F.col("follow_gps"), F.col("start"), F.col("gps"))
    rows = routable_requests(fx.sessions(spark, sf).withColumn("start", start))
    return rows.select("event_id", F.col("start.lat_e7").alias("start_lat"), F.col("start.lon_e7").alias("start_lon"), F.col("end.lat_e7").alias("end_lat"))


@query(
    "p9_settled_only",
    fx.with_tables("size", "nodes", "fixes", "sessions") + "SELECT session_id, event_id FROM sessions WHERE NOT is_dragging AND end_at IS NOT NULL",
)
def settled(spark: SparkSession, sf: str) -> DataFrame:
    return settled_only(fx.sessions(spark, sf), "end").select("session_id", "event_id")


@query(
    "p10_f8_f15_query_texts",
    fx.with_tables("queries")
    + """SELECT query_id, length(q) > 3 AS searchable,
  array_to_string(list_filter(string_split_regex(q, ' +'), lambda w: length(w) >= 3), ' ') AS filtered,
  CASE WHEN lat_min IS NULL THEN '' ELSE printf(' $GEO[%f;%f;%f;%f;1]', lat_min, lat_max, lon_min, lon_max) END AS geo
FROM queries""",
)
def query_texts(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("q")
    box = (F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max"))
    return fx.queries(spark, sf).select(
        "query_id", text.searchable_text(q).alias("searchable"), text.filter_query(q).alias("filtered"), text.geo_filter_text(*box).alias("geo")
    )


@query(
    "f1_f2_f3_coordinates",
    fx.with_tables("fixes")
    + """SELECT event_id, lat_e7, lat_e6, lat_e6 * 10 AS snapped, lat_e6 * 10 AS back, lat_e7 / 1e7 AS deg FROM (
  SELECT *, CAST(trunc(lat_e7 / 10) AS INTEGER) AS lat_e6 FROM (
    SELECT event_id, CAST(floor(CASE WHEN event_id % 2 = 1 THEN -lat ELSE lat END * 1e7 + 0.5) AS INTEGER) AS lat_e7 FROM fixes))""",
)
def coordinates(spark: SparkSession, sf: str) -> DataFrame:
    e7 = F.col("lat_e7")
    lat = F.when(F.col("event_id") % 2 == 1, -F.col("lat")).otherwise(F.col("lat"))
    at = fx.gps_fixes(spark, sf).select("event_id", geo.to_e7(lat).alias("lat_e7"))
    return at.select(
        "event_id", "lat_e7", geo.e7_to_e6(e7).alias("lat_e6"), geo.snap_e6(e7).alias("snapped"), geo.e6_to_e7(geo.e7_to_e6(e7)).alias("back"), geo.e7_to_deg(e7).alias("deg")
    )


@query(
    "f4_format_position",
    fx.with_tables("points") + "SELECT point_id, printf('[%+12.7f N %+12.7f W]', lat_e7 / 1e7, lon_e7 / 1e7) AS shown FROM points",
)
def positions_shown(spark: SparkSession, sf: str) -> DataFrame:
    return fx.query_points(spark, sf).select("point_id", geo.format_position(F.col("lat_e7"), F.col("lon_e7")).alias("shown"))


@query(
    "f5_f6_f7_mercator",
    fx.with_tables("points")
    + """, px AS (SELECT point_id, lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon, sin(radians(lat_e7 / 1e7)) AS s FROM points),
xy AS (SELECT *, (lon + 180) / 360 * 4194304 AS x, (0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 4194304 AS y FROM px)
SELECT point_id, CAST(round(x * 1000) AS BIGINT) AS x, CAST(round(y * 1000) AS BIGINT) AS y, CAST(round(lat * 1000000) AS BIGINT) AS lat,
  CAST(round(lon * 1000000) AS BIGINT) AS lon, CAST(round((lon - 2048 * 360 / 4194304) * 1000000) AS BIGINT) AS lon_min,
  CAST(round(degrees(atan(sinh((0.5 - (y - 2048) / 4194304) * 2 * pi()))) * 1000000) AS BIGINT) AS lat_max,
  CAST(round((lon + 2048 * 360 / 4194304) * 1000000) AS BIGINT) AS lon_max,
  CAST(round(degrees(atan(sinh((0.5 - (y + 2048) / 4194304) * 2 * pi()))) * 1000000) AS BIGINT) AS lat_min FROM xy""",
)
def mercator(spark: SparkSession, sf: str) -> DataFrame:
    at = fx.query_points(spark, sf).select("point_id", geo.e7_to_deg(F.col("lat_e7")).alias("lat"), geo.e7_to_deg(F.col("lon_e7")).alias("lon"))
    x, y = geo.mercator_px(F.col("lon"), F.col("lat"), 14)
    lon, lat = geo.mercator_inverse(x, y, 14)
    view = geo.viewport_rect(F.col("lat"), F.col("lon"), F.lit(14))
    whole = lambda c, k: F.round(c * k).cast("bigint")
    return at.select("point_id", whole(x, 1000).alias("x"), whole(y, 1000).alias("y"), whole(lat, 1_000_000).alias("lat"), whole(lon, 1_000_000).alias("lon"), whole(view["lon_min"], 1_000_000).alias("lon_min"), whole(view["lat_max"], 1_000_000).alias("lat_max"), whole(view["lon_max"], 1_000_000).alias("lon_max"), whole(view["lat_min"], 1_000_000).alias("lat_min"))


@query(
    "f9_f10_item_labels",
    fx.with_tables("items")
    + """SELECT item_id, array_to_string(strs, ', ') AS label, CASE WHEN placed THEN CAST(floor(lat * 1e7 + 0.5) AS INTEGER) END AS lat_e7,
  CASE WHEN placed THEN CAST(floor(lon * 1e7 + 0.5) AS INTEGER) END AS lon_e7 FROM items""",
)
def item_labels(spark: SparkSession, sf: str) -> DataFrame:
    at = search.item_position(fx.items(spark, sf))
    return at.select("item_id", text.item_label(F.col("strs")).alias("label"), "lat_e7", "lon_e7")


_TEXTS = """SELECT o_orderkey, m // 100 AS secs, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'Distance: ' || (m + 50) // 100 // 10 || '.' || (m + 50) // 100 % 10 || ' km Time: ' ||
  CASE WHEN s >= 3600 THEN (s // 3600) || ' h ' || (s // 60 % 60) || ' min'
    WHEN s >= 60 THEN ((s * 20 + 60) // 120 // 10) || '.' || ((s * 20 + 60) // 120 % 10) || ' min' ELSE s || ' s' END END AS summary, s * 1 AS time_s
FROM (SELECT o_orderkey, m, m * 9 // 325 AS s FROM (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_orderkey AS BIGINT) * 37 % 500000 AS m FROM orders))"""


@query("f11_f12_f13_f14_route_texts", _TEXTS)
def route_texts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("bigint")
    rows = table(spark, sf, "orders").select(key.alias("o_orderkey"), (key * 37 % 500000).alias("m"))
    s = text.travel_time_s(F.col("m"))
    shown = text.route_summary(F.when(key % 50 != 0, F.col("m")), s)
    return rows.select("o_orderkey", F.floor(F.col("m") / 100).alias("secs"), shown.alias("summary"), s.cast("bigint").alias("time_s"))


@query(
    "j1_w1_snap_points",
    fx.with_tables("size", "nodes", "points", "snapped") + "SELECT * FROM snapped",
)
def snap_points(spark: SparkSession, sf: str) -> DataFrame:
    return snap.snap_points(fx.query_points(spark, sf), fx.nodes(spark, sf)).select("point_id", "node_id", "dist2")


@query(
    "j2_snap_endpoints",
    fx.with_tables("size", "nodes", "beside", "snapped", "requests", "snapped_requests") + "SELECT * FROM found",
)
def snap_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    done = snap.snap_endpoints(fx.position_requests(spark, sf), fx.nodes(spark, sf))
    return done.select("request_id", "start_node", "dest_node")


def _cone_sql(direction: str, end: str, near: str, far: str) -> str:
    return (
        fx.with_tables("size", "road", "hierarchy", "edges", "requests", recursive=True)
        + f""", cone AS (
  SELECT DISTINCT {end} AS root, {end} AS node FROM requests, size WHERE {end} % (1 << top) <> 0
  UNION
  SELECT root, {far} FROM cone JOIN edges ON owner = node, size WHERE direction = '{direction}' AND {far} % (1 << top) <> 0)
SELECT root, edge_id, src, dst, dist FROM cone JOIN edges ON owner = node WHERE direction = '{direction}'"""
    )


@query("g1_up_cone", _cone_sql("out", "start_node", "src", "dst"))
def up_cone(spark: SparkSession, sf: str) -> DataFrame:
    roots = fx.route_requests(spark, sf).select(F.col("start_node").alias("root"))
    return graph.up_cone(roots, fx.edges(spark, sf), fx.nodes(spark, sf))


@query("g2_down_cone", _cone_sql("in", "dest_node", "dst", "src"))
def down_cone(spark: SparkSession, sf: str) -> DataFrame:
    roots = fx.route_requests(spark, sf).select(F.col("dest_node").alias("root"))
    return graph.down_cone(roots, fx.edges(spark, sf), fx.nodes(spark, sf))


@query(
    "g3_s3_search_graph",
    fx.with_tables("size", "road", "hierarchy", "edges", "requests", recursive=True)
    + """, up AS (
  SELECT DISTINCT start_node AS root, start_node AS node FROM requests, size WHERE start_node % (1 << top) <> 0
  UNION SELECT root, dst FROM up JOIN edges ON owner = node, size WHERE direction = 'out' AND dst % (1 << top) <> 0),
down AS (
  SELECT DISTINCT dest_node AS root, dest_node AS node FROM requests, size WHERE dest_node % (1 << top) <> 0
  UNION SELECT root, src FROM down JOIN edges ON owner = node, size WHERE direction = 'in' AND src % (1 << top) <> 0),
layers AS (
  SELECT request_id, 'up' AS layer, edge_id, dist FROM requests JOIN up ON root = start_node JOIN edges ON owner = node WHERE direction = 'out'
  UNION ALL SELECT request_id, 'down', edge_id, dist FROM requests JOIN down ON root = dest_node JOIN edges ON owner = node WHERE direction = 'in'
  UNION ALL SELECT -1, 'core', edge_id, dist FROM edges, size WHERE direction = 'out' AND owner % (1 << top) = 0)
SELECT request_id, layer, count(*) AS edges, CAST(sum(dist) AS BIGINT) AS dist FROM layers GROUP BY 1, 2""",
)
def search_graph(spark: SparkSession, sf: str) -> DataFrame:
    requests, (nodes, edges) = fx.route_requests(spark, sf), _graph(spark, sf)
    both = graph.cones(*(requests.select(F.col(end).alias("root")) for end in ("start_node", "dest_node")), edges, nodes)
    up, down = (both.where(F.col("direction") == d) for d in ("out", "in"))
    own = graph.search_graph(requests, up, down).select("request_id", "layer", "dist")
    core = graph.core_edges(edges, nodes).select(F.lit(-1).cast("bigint").alias("request_id"), F.lit("core").alias("layer"), "dist")
    return own.unionByName(core).groupBy("request_id", "layer").agg(F.count("*").alias("edges"), F.sum("dist").alias("dist"))


_ROUTES = ("size", "road", "requests", "lengths")


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as tables at rest, which every round reads."""
    return cut(fx.nodes(spark, sf)), cut(fx.edges(spark, sf))


@query("g4_a2_shortest_paths", fx.with_tables(*_ROUTES) + "SELECT request_id, dist FROM lengths")
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    requests = fx.route_requests(spark, sf)
    return graph.path_length(requests, routing.solve(requests, *_graph(spark, sf)))


@query("g4_meeting_paths", fx.with_tables(*_ROUTES) + "SELECT request_id, dist FROM lengths")
def meeting_paths(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return graph.meeting_paths(fx.route_requests(spark, sf), edges, nodes)


@query("g4_general_graph")
def general_graph(spark: SparkSession, sf: str) -> DataFrame:
    requests, edges = fx.route_requests(spark, sf), cut(fx.general_edges(spark, sf))
    return graph.path_length(requests, graph.shortest_paths(requests, None, edges))


@query(
    "g4_tied_paths",
    fx.with_tables("size", "grid")
    + """, steps AS (
  SELECT *, unnest(generate_series(0, abs(ty - sy) + abs(tx - sx))) AS seq FROM rides),
moved AS (SELECT *, abs(ty - sy) AS rows_, least(seq, abs(ty - sy)) AS down, greatest(seq - abs(ty - sy), 0) AS along FROM steps),
placed AS (SELECT *, sx + sign(tx - sx) * along AS x, sy + sign(ty - sy) * down AS y FROM moved)
SELECT request_id, seq, CAST(y * w + x AS BIGINT) AS node_id, seq * 7 AS dist,
  CAST(CASE WHEN seq = 0 THEN NULL WHEN seq <= rows_ AND ty > sy THEN 2097152 + (y - 1) * w + x WHEN seq <= rows_ THEN 3145728 + (y + 1) * w + x
    WHEN tx > sx THEN y * w + x - 1 ELSE 1048576 + y * w + x + 1 END AS BIGINT) AS edge_id
FROM placed""",
)
def tied_paths(spark: SparkSession, sf: str) -> DataFrame:
    requests, edges = fx.grid_requests(spark, sf), cut(fx.grid_edges(spark, sf))
    labels = cut(graph.shortest_paths(requests, None, edges))
    dist = labels.select("request_id", F.col("node").alias("node_id"), "dist")
    return graph.backtrack(requests, labels).join(large(dist), ["request_id", "node_id"]).select("request_id", "seq", "node_id", "dist", "edge_id")


@query(
    "g5_j4_backtrack",
    fx.with_tables(*_ROUTES) + "SELECT request_id, dist, start_node AS first, dest_node AS last, euclid FROM lengths",
)
def backtrack(spark: SparkSession, sf: str) -> DataFrame:
    requests, (nodes, edges) = fx.route_requests(spark, sf), _graph(spark, sf)
    path = cut(graph.backtrack(requests, routing.solve(requests, nodes, edges)))
    steps = graph.edge_lookup(path.where("edge_id IS NOT NULL"), cut(fx.edge_details(spark, sf))).join(large(edges.select("edge_id", "dist")), "edge_id")
    sums = steps.groupBy("request_id").agg(F.sum("dist").alias("dist"), F.sum("euclid").alias("euclid"))
    ends = path.groupBy("request_id").agg(F.min_by("node_id", "seq").alias("first"), F.max_by("node_id", "seq").alias("last"))
    none = F.lit(0).cast("bigint")
    return ends.join(large(sums), "request_id", "left").select("request_id", F.coalesce("dist", none).alias("dist"), "first", "last", F.coalesce("euclid", none).alias("euclid"))


@query(
    "g6_unpack_shortcuts",
    fx.with_tables(*_ROUTES)
    + """SELECT request_id, unnest(generate_series(0, abs(dest_node - start_node))) AS seq,
  unnest(CASE WHEN dest_node >= start_node THEN generate_series(start_node, dest_node) ELSE generate_series(start_node, dest_node, -1) END) AS node_id
FROM lengths""",
)
def unpack(spark: SparkSession, sf: str) -> DataFrame:
    requests, (nodes, edges) = fx.route_requests(spark, sf), _graph(spark, sf)
    path = cut(graph.backtrack(requests, routing.solve(requests, nodes, edges)))
    return graph.unpack_shortcuts(path, edges, cut(fx.edge_details(spark, sf))).select("request_id", "seq", "node_id")


_STEPS = """, steps AS (
  SELECT request_id, unnest(generate_series(0, abs(dest_node - start_node))) AS seq,
    unnest(CASE WHEN dest_node >= start_node THEN generate_series(start_node, dest_node) ELSE generate_series(start_node, dest_node, -1) END) AS node_id
  FROM lengths)
"""


def _parts(spark: SparkSession, sf: str, part: Callable[[DataFrame], DataFrame]) -> DataFrame:
    requests, (nodes, edges) = fx.route_requests(spark, sf), _graph(spark, sf)
    path = cut(graph.backtrack(requests, routing.solve(requests, nodes, edges)))
    extents = graph.leaf_extents(edges, nodes, cut(fx.edge_details(spark, sf)))
    return graph.unpack_parts(path, part(requests), extents, nodes)


@query(
    "g6_unpack_stretches",
    fx.with_tables(*_ROUTES) + _STEPS + "SELECT request_id AS part_id, request_id, seq, node_id FROM steps WHERE seq BETWEEN request_id % 19 AND request_id % 19 + 9",
)
def unpack_stretches(spark: SparkSession, sf: str) -> DataFrame:
    first = F.col("request_id") % 19
    none = [F.lit(None).cast("int").alias(c) for c in ("west", "east", "south", "north")]
    return _parts(spark, sf, lambda r: r.select(F.col("request_id").alias("part_id"), "request_id", first.alias("first"), (first + 9).alias("last"), *none))


@query(
    "g6_unpack_in_view",
    fx.with_tables("size", "nodes", *_ROUTES[1:])
    + _STEPS
    + """SELECT request_id % 9 AS part_id, request_id, seq, node_id FROM steps JOIN nodes USING (node_id)
WHERE lon_e7 BETWEEN 60000000 + request_id % 9 * 9000000 AND 75000000 + request_id % 9 * 9000000 AND lat_e7 BETWEEN 480000000 AND 530000000""",
)
def unpack_in_view(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("request_id") % 9
    none = [F.lit(None).cast("bigint").alias(c) for c in ("first", "last")]
    box = {"west": number * 9_000_000 + 60_000_000, "east": number * 9_000_000 + 75_000_000, "south": F.lit(480_000_000), "north": F.lit(530_000_000)}
    return _parts(spark, sf, lambda r: r.select(number.alias("part_id"), "request_id", *none, *(v.alias(k) for k, v in box.items())))


_ROUTED = (
    fx.with_tables("size", "nodes", "beside", "snapped", "road", "requests", "snapped_requests")
    + ", "
    + fx.SQL["lengths"].replace("FROM requests JOIN", "FROM found JOIN")
    + """, timed AS (SELECT *, dist * 9 // 325 AS s, euclid AS m FROM lengths)
SELECT request_id, dist, euclid, CAST(s AS INTEGER) AS travel_time_s, abs(dest_node - start_node) + 1 AS points, f.lat_e7 AS first_lat, l.lat_e7 AS last_lat,
  'Distance: ' || (m + 50) // 100 // 10 || '.' || (m + 50) // 100 % 10 || ' km Time: ' ||
  CASE WHEN s >= 3600 THEN (s // 3600) || ' h ' || (s // 60 % 60) || ' min'
    WHEN s >= 60 THEN ((s * 20 + 60) // 120 // 10) || '.' || ((s * 20 + 60) // 120 % 10) || ' min' ELSE s || ' s' END AS summary
FROM timed JOIN nodes f ON f.node_id = start_node JOIN nodes l ON l.node_id = dest_node"""
)


@query("g7_a1_a3_j3_o1_w4_find_routes", _ROUTED)
def find_routes(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(routing.find_routes(cut(fx.position_requests(spark, sf)), *_graph(spark, sf), cut(fx.edge_details(spark, sf))))


def _shown(done: DataFrame) -> DataFrame:
    return done.select(
        "request_id", "dist", "euclid", "travel_time_s", F.size("way").cast("bigint").alias("points"), F.element_at("way", 1)["lat_e7"].alias("first_lat"), F.element_at("way", -1)["lat_e7"].alias("last_lat"), "summary"
    )


@query("w4_route_store", _ROUTED)
def route_store(spark: SparkSession, sf: str) -> DataFrame:
    """The requests that start in the south first, then all of them from the same store."""
    requests, graph_, details = cut(fx.position_requests(spark, sf)), _graph(spark, sf), cut(fx.edge_details(spark, sf))
    folder, version = f"{shared_folder(spark)}/routes-{uuid4().hex}", graph_version(*graph_, details)
    route = lambda asked: routing.find_routes(asked, *graph_, details)
    find_routes_once(requests.where("start.lat_e7 < 510000000"), version, route, folder)
    return _shown(find_routes_once(requests, version, route, folder))


@query("g8_validate_graph", "SELECT CAST(NULL AS VARCHAR) AS rule, CAST(NULL AS BIGINT) AS id WHERE FALSE")
def validate_graph(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate_graph(*_graph(spark, sf), cut(fx.edge_details(spark, sf)))


@query(
    "g8_validate_broken_graph",
    "SELECT rule, id FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, 'details_missing' AS rule FROM orders)",
)
def validate_broken(spark: SparkSession, sf: str) -> DataFrame:
    none = fx.edge_details(spark, sf).where("FALSE")
    return validate.validate_graph(fx.nodes(spark, sf), fx.general_edges(spark, sf), none)


@query(
    "g8_every_rule",
    fx.with_tables("size", "nodes", "road", "hierarchy", "edges", "details", "broken_graph")
    + """, chain AS (
  SELECT d.*, o.src AS s, o.dst AS t, o.dist, a.src AS s1, a.dst AS t1, a.dist AS w1, b.src AS s2, b.dst AS t2, b.dist AS w2
  FROM bad_details d JOIN bad_edges o ON o.edge_id = d.edge_id LEFT JOIN bad_edges a ON a.edge_id = shortcut1 LEFT JOIN bad_edges b ON b.edge_id = shortcut2
  WHERE shortcut_node <> -1)
SELECT 'core_in_list' AS rule, edge_id AS id FROM bad_edges WHERE direction = 'in' AND owner IN (SELECT node_id FROM nodes WHERE is_core)
UNION ALL SELECT 'src_missing', edge_id FROM bad_edges WHERE src NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT 'dst_missing', edge_id FROM bad_edges WHERE dst NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT 'details_missing', edge_id FROM bad_edges WHERE edge_id NOT IN (SELECT edge_id FROM bad_details)
UNION ALL SELECT 'edge_twice', edge_id FROM bad_edges GROUP BY edge_id HAVING count(*) > 1
UNION ALL SELECT 'negative_length', edge_id FROM bad_edges WHERE dist < 0
UNION ALL SELECT 'half_missing', edge_id FROM chain WHERE s1 IS NULL OR s2 IS NULL
UNION ALL SELECT 'halves_apart', edge_id FROM chain WHERE s1 <> s OR t1 <> shortcut_node OR s2 <> shortcut_node OR t2 <> t
UNION ALL SELECT 'halves_length', edge_id FROM chain WHERE w1 + w2 <> dist
UNION ALL SELECT 'edge_number', edge_id FROM bad_edges WHERE edge_id >= (SELECT count(*) FROM bad_edges)
UNION ALL SELECT 'block_number', node_id FROM nodes WHERE node_id // 1024 >= 1
UNION ALL SELECT 'slot_number', node_id FROM nodes WHERE node_id % 1024 >= 100""",
)
def every_rule(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate_graph(cut(fx.nodes(spark, sf)), *(cut(df) for df in fx.broken_graph(spark, sf)), block_size=100, block_count=1)


@query(
    "g8_block_chains",
    fx.with_tables("size", "block_chains", recursive=True)
    + """, links AS (SELECT block, next_block FROM blocks WHERE next_block BETWEEN 0 AND n - 1),
walk AS (SELECT block AS head, next_block AS block FROM links UNION SELECT head, next_block FROM walk JOIN links USING (block)),
chains AS (SELECT head, block FROM walk, (SELECT any_value(cells) AS cells FROM blocks) WHERE head < cells UNION SELECT block, block FROM blocks WHERE block < cells)
SELECT 'next_block' AS rule, block AS id FROM blocks WHERE next_block < -1 OR next_block >= n
UNION ALL SELECT 'node_count', block FROM blocks WHERE held > 2
UNION ALL SELECT 'block_cycle', block FROM walk WHERE head = block
UNION ALL SELECT 'block_shared', next_block FROM links, (SELECT any_value(cells) AS cells FROM blocks) GROUP BY next_block, cells HAVING count(*) > 1 OR next_block < cells
UNION ALL SELECT 'block_unreachable', block FROM blocks WHERE block NOT IN (SELECT block FROM chains)
UNION ALL SELECT DISTINCT 'cell_mixed', head FROM chains JOIN blocks USING (block) WHERE cell_id <> head""",
)
def block_chains(spark: SparkSession, sf: str) -> DataFrame:
    blocks, nodes, cells, count = fx.block_chains(spark, sf)
    return validate.validate_chains(blocks, nodes, cells, count, 2)


@query(
    "s2_graph_tables",
    fx.with_tables("size", "road", "hierarchy", "edges") + "SELECT * FROM edges",
)
def graph_tables(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/graph-{uuid4().hex}"
    write_graph_tables({"nodes": fx.nodes(spark, sf), "edges": fx.edges(spark, sf), "edge_details": fx.edge_details(spark, sf)}, folder)
    return load_graph_tables(spark, folder)["edges"]


@query("s2_g1_laid_out_cones", _cone_sql("out", "start_node", "src", "dst"))
def laid_out_cones(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/graph-{uuid4().hex}"
    write_graph_tables({"nodes": fx.nodes(spark, sf), "edges": fx.edges(spark, sf), "edge_details": fx.edge_details(spark, sf)}, folder)
    stored, roots = load_graph_tables(spark, folder), fx.route_requests(spark, sf).select(F.col("start_node").alias("root"))
    return graph.cones(roots, roots.where("FALSE"), stored["edges"], stored["nodes"], laid_out=True).drop("direction")


@query(
    "s1_h1_graph_file",
    fx.with_tables("size", "road", "hierarchy", "edges", "numbered") + "SELECT edge_id, owner, direction, src, dst, dist FROM numbered",
)
def graph_file(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{uuid4().hex}.graph"
    fx.write_graph_file(spark, sf, path)
    return read_graph_file(spark, path)[2]


@query(
    "s1_graph_file_nodes",
    fx.with_tables("size", "nodes")
    + """, low AS (SELECT *, 1 << top AS step, n - 1 - (n - 1) // (1 << top) AS below FROM size)
SELECT CASE WHEN is_core THEN (below + 1023) // 1024 * 1024 + node_id // step ELSE node_id - node_id // step - 1 END AS node_id, lon_e7, lat_e7, cell_id, is_core FROM nodes, low""",
)
def graph_file_nodes(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{uuid4().hex}.graph"
    fx.write_graph_file(spark, sf, path)
    return read_graph_file(spark, path)[1].select("node_id", "lon_e7", "lat_e7", "cell_id", "is_core")


@query(
    "g8_validate_ranges",
    """WITH r AS (SELECT CAST(o_orderkey AS BIGINT) AS owner, o_orderkey * 2 AS a, o_orderkey * 2 + o_orderkey % 3 - 1 AS b, o_orderkey * 2 + 2 + (o_orderkey % 5 = 4)::INT AS e FROM orders)
SELECT 'range_backward' AS rule, owner AS id FROM r WHERE a > b OR b > e
UNION ALL SELECT 'range_overlap', r.owner FROM r JOIN r s ON s.owner = r.owner + 1 WHERE s.a < r.e
UNION ALL SELECT 'last_offset', CAST(max(e) AS BIGINT) FROM r HAVING max(e) <> 7""",
)
def validate_ranges(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("bigint")
    end = key * 2 + 2 + (key % 5 == 4).cast("bigint")
    ranges = table(spark, sf, "orders").select(key.alias("owner"), (key * 2).alias("out_start"), (key * 2 + key % 3 - 1).alias("in_start"), end.alias("end"))
    return validate.validate_ranges(ranges, fx.BLOCK, 7)


_MATCHES = (
    fx.with_tables("items", "queries")
    + """, words AS (SELECT query_id, list_distinct(list_filter(string_split_regex(lower(q), ' +'), lambda w: length(w) >= 3)) AS ws FROM queries WHERE length(q) > 3),
matches AS (
  SELECT query_id, item_id FROM words, items WHERE len(ws) > 0
    AND len(list_filter(ws, lambda w: len(list_filter(strs, lambda s: contains(lower(s), w))) > 0)) = len(ws))"""
)


@query("j5_match_items", _MATCHES + " SELECT * FROM matches")
def match_items(spark: SparkSession, sf: str) -> DataFrame:
    return search.match_items(fx.queries(spark, sf).where(text.searchable_text(F.col("q"))), fx.items(spark, sf))


@query(
    "j6_match_in_rect",
    _MATCHES
    + """ SELECT m.query_id, m.item_id FROM matches m JOIN queries q USING (query_id) JOIN items i USING (item_id)
WHERE lat_min IS NULL OR (placed AND lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max)""",
)
def match_in_rect(spark: SparkSession, sf: str) -> DataFrame:
    queries, items = fx.queries(spark, sf), fx.items(spark, sf)
    return search.match_in_rect(queries, items, search.match_items(queries, items))


@query(
    "j7_w2_w5_search",
    _MATCHES
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS rn FROM matches),
inside AS (
  SELECT m.query_id, m.item_id, row_number() OVER (PARTITION BY m.query_id ORDER BY m.item_id) AS rn
  FROM matches m JOIN queries q USING (query_id) JOIN items i USING (item_id)
  WHERE placed AND len(strs) > 0 AND (lat_min IS NULL OR (lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max))),
hits AS (SELECT query_id, item_id FROM inside WHERE rn <= 20),
have AS (SELECT query_id, count(h.item_id) AS have FROM queries LEFT JOIN hits h USING (query_id) WHERE lat_min IS NOT NULL GROUP BY query_id),
taken AS (SELECT query_id, lat, lon FROM hits JOIN items USING (item_id)),
more AS (
  SELECT r.query_id, r.item_id FROM ranked r JOIN have USING (query_id) JOIN items i USING (item_id)
  WHERE rn <= 20 - have AND placed AND len(strs) > 0
    AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.query_id = r.query_id AND t.lat = i.lat AND t.lon = i.lon)),
both_ AS (SELECT *, 1 AS phase FROM hits UNION ALL SELECT *, 2 FROM more)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY phase, item_id) AS INTEGER) AS rank, item_id, array_to_string(strs, ', ') AS label,
  CAST(floor(lat * 1e7 + 0.5) AS INTEGER) AS lat_e7, CAST(floor(lon * 1e7 + 0.5) AS INTEGER) AS lon_e7
FROM both_ JOIN items USING (item_id)""",
)
def place_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(fx.queries(spark, sf), fx.items(spark, sf))


@query("t1_h3_filter_gps", fx.with_tables("fixes", "kept", recursive=True) + "SELECT event_id, device_id, ts_ms, accuracy, lat, lon FROM kept")
def filter_gps(spark: SparkSession, sf: str) -> DataFrame:
    return tracking.filter_gps(fx.gps_fixes(spark, sf)).select("event_id", "device_id", "ts_ms", "accuracy", "lat", "lon")


@query(
    "t2_w3_gps_positions",
    fx.with_tables("fixes", "kept", recursive=True)
    + """, e7 AS (SELECT device_id, event_id, ts_ms, CAST(floor(lat * 1e7 + 0.5) AS INTEGER) AS lat_e7, CAST(floor(lon * 1e7 + 0.5) AS INTEGER) AS lon_e7 FROM kept),
b AS (SELECT *, lag(lat_e7) OVER w AS lat0, lag(lon_e7) OVER w AS lon0 FROM e7 WINDOW w AS (PARTITION BY device_id ORDER BY ts_ms, event_id))
SELECT device_id, event_id, lat_e7, lon_e7 FROM b WHERE (lat_e7, lon_e7) IS DISTINCT FROM (lat0, lon0)""",
)
def gps_positions(spark: SparkSession, sf: str) -> DataFrame:
    moved = tracking.gps_positions(tracking.filter_gps(fx.gps_fixes(spark, sf)))
    return moved.select("device_id", "event_id", "gps.lat_e7", "gps.lon_e7")


@query(
    "t3_latest_request",
    fx.with_tables("size", "nodes", "fixes", "sessions")
    + "SELECT session_id, max_by(event_id, (ts_ms, event_id)) AS event_id, max(ts_ms) AS ts_ms FROM sessions WHERE NOT is_dragging AND end_at IS NOT NULL GROUP BY session_id",
)
def latest_request(spark: SparkSession, sf: str) -> DataFrame:
    live = settled_only(fx.sessions(spark, sf), "end").select("session_id", "event_id", "ts_ms", "end")
    return tracking.latest_request(live).select("session_id", "event_id", "ts_ms")


@query(
    "t4_p7_p9_session_requests",
    fx.with_tables("size", "nodes", "fixes", "kept", "session_log", recursive=True)
    + """, seen AS (
  SELECT *, list(point) FILTER (kind = 'start') OVER w AS starts, list(point) FILTER (kind = 'end') OVER w AS ends, list(point) FILTER (kind = 'gps') OVER w AS places,
    coalesce(last_value(CASE WHEN kind = 'follow' THEN flag END IGNORE NULLS) OVER w, TRUE) AS follow_gps,
    coalesce(last_value(CASE WHEN kind = 'drag' THEN flag END IGNORE NULLS) OVER w, FALSE) AS dragging,
    count(*) FILTER (kind <> 'gps') OVER w AS own
  FROM log WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING)),
chosen AS (
  SELECT session_id, device_id, ts_ms, event_id, ends[-1] AS e,
    CASE WHEN follow_gps THEN coalesce(places[-1], starts[-1]) ELSE coalesce(starts[-1], places[-1]) END AS s
  FROM seen WHERE own > 0 AND NOT dragging),
asked AS (SELECT session_id, device_id, ts_ms, event_id, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN {'s': s, 'e': e} END AS a FROM chosen),
b AS (SELECT *, lag(a) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS a0 FROM asked)
SELECT session_id, device_id, ts_ms, event_id, a.s.lat_e7 AS start_lat, a.s.lon_e7 AS start_lon, a.e.lat_e7 AS end_lat, a.e.lon_e7 AS end_lon
FROM b WHERE a IS DISTINCT FROM a0""",
)
def session_requests(spark: SparkSession, sf: str) -> DataFrame:
    asked = sessions.session_requests(sessions.event_log(*fx.session_log(spark, sf)))
    ends = [F.col(f"{e}.{c}_e7").alias(f"{e}_{c}") for e in ("start", "end") for c in ("lat", "lon")]
    return asked.select("session_id", "device_id", "ts_ms", "event_id", *ends)


def _level_tables() -> str:
    """The rule level by level: each fold carries the last point kept, over the points that the finer levels left."""
    out = ["""ends AS (SELECT *, (lon + 180) / 360 * 256 AS x, (0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 AS y,
    row_number() OVER (PARTITION BY device_id ORDER BY ts_ms, event_id) - 1 AS seq FROM fixes),
left0 AS (SELECT device_id AS route_id, seq, x, y FROM ends)"""]
    for k, before in enumerate((polyline.NEVER, *polyline.LEVELS[:-1])):
        far = lambda x, y: f"sqrt((i.x - {x}) * (i.x - {x}) + (i.y - {y}) * (i.y - {y})) * {2.0 ** (before - 1)!r} >= 16"  # noqa: B023, E731
        keep = f"(i.rn = i.n OR {far('f.lx', 'f.ly')} OR {far('i.nx', 'i.ny')})"
        out.append(
            f"""play{k} AS (
  SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w AS rn, count(*) OVER (PARTITION BY route_id) AS n
  FROM left{k} WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
fold{k} AS (
  SELECT route_id, rn, seq, x, y, x AS lx, y AS ly, TRUE AS keep FROM play{k} WHERE rn = 1
  UNION ALL
  SELECT i.route_id, i.rn, i.seq, i.x, i.y, CASE WHEN {keep} THEN i.x ELSE f.lx END, CASE WHEN {keep} THEN i.y ELSE f.ly END, {keep}
  FROM fold{k} f JOIN play{k} i ON i.route_id = f.route_id AND i.rn = f.rn + 1),
left{k + 1} AS (SELECT route_id, seq, x, y FROM fold{k} WHERE keep)"""
        )
    kept = " UNION ALL ".join(f"SELECT route_id, seq, {z} AS z FROM left{k + 1}" for k, z in enumerate(polyline.LEVELS))
    out.append(
        f"""lasts AS (SELECT route_id, max(seq) AS final FROM left0 GROUP BY 1),
zooms AS (SELECT route_id, seq, min(z) AS z FROM ({kept}) GROUP BY 1, 2),
levels_of AS (
  SELECT p.route_id, CAST(p.seq AS INTEGER) AS seq, CAST(CASE WHEN p.seq IN (0, final) THEN 0 ELSE coalesce(z, {polyline.NEVER}) END AS INTEGER) AS min_zoom
  FROM left0 p JOIN lasts USING (route_id) LEFT JOIN zooms USING (route_id, seq))"""
    )
    return ",\n".join(out)


_LEVELS = fx.with_tables("fixes", recursive=True) + ", " + _level_tables()


@query("h2_polyline_levels", _LEVELS + " SELECT * FROM levels_of")
def polyline_levels(spark: SparkSession, sf: str) -> DataFrame:
    levels = polyline.polyline_levels(fx.route_points(spark, sf))
    return levels.select("route_id", "seq", "min_zoom")


@query("p11_simplify_routes", _LEVELS + " SELECT * FROM levels_of WHERE min_zoom <= 8")
def simplify(spark: SparkSession, sf: str) -> DataFrame:
    return polyline.simplify_routes(polyline.polyline_levels(fx.route_points(spark, sf)), 8).select("route_id", "seq", "min_zoom")


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.mercator_px(F.col("lon"), F.col("lat"))
    return fx.route_points(spark, sf).select("route_id", "seq", x.alias("x"), y.alias("y"))


_BOXES = (
    fx.with_tables("fixes", recursive=True)
    + """, pts AS (SELECT device_id AS route_id, row_number() OVER (PARTITION BY device_id ORDER BY ts_ms, event_id) - 1 AS seq,
    (lon + 180) / 360 * 256 AS x, (0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 AS y FROM fixes),
spans AS (
  SELECT route_id, count(*) AS n, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM pts GROUP BY route_id
  UNION ALL
  SELECT route_id, n, unnest([first, (first + last) // 2]), unnest([(first + last) // 2, last]) FROM spans WHERE last - first > 4),
boxes AS (
  SELECT s.route_id, greatest(first - 1, 0) AS first, least(last + 1, n - 1) AS last, min(x) AS l, max(x) AS r, min(y) AS b, max(y) AS t
  FROM spans s JOIN pts p ON p.route_id = s.route_id AND seq BETWEEN first AND last WHERE last - first <= 4 GROUP BY s.route_id, first, last, n)"""
)
_ROUNDED = "CAST(round({0} * 1000000) AS BIGINT)"


@query(
    "a4_h4_bounding_boxes",
    _BOXES + " SELECT route_id, first, last, " + ", ".join(f"{_ROUNDED.format(c)} AS {n}" for c, n in (("l", "x0"), ("r", "x1"), ("b", "y0"), ("t", "y1"))) + " FROM boxes",
)
def bounding_boxes(spark: SparkSession, sf: str) -> DataFrame:
    whole = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    boxes = polyline.bounding_boxes(_pixels(spark, sf))
    return boxes.select("route_id", "first", "last", whole("left").alias("x0"), whole("right").alias("x1"), whole("bottom").alias("y0"), whole("top").alias("y1"))


@query(
    "a4_route_boxes",
    _BOXES + " SELECT route_id, " + ", ".join(f"{_ROUNDED.format(c)} AS {n}" for c, n in (("min(l)", "x0"), ("max(r)", "x1"), ("min(b)", "y0"), ("max(t)", "y1"))) + " FROM boxes GROUP BY route_id",
)
def route_boxes(spark: SparkSession, sf: str) -> DataFrame:
    whole = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    boxes = polyline.route_boxes(polyline.bounding_boxes(_pixels(spark, sf)))
    return boxes.select("route_id", whole("left").alias("x0"), whole("right").alias("x1"), whole("bottom").alias("y0"), whole("top").alias("y1"))


_HITS = (
    _BOXES
    + """, v AS (
  SELECT k AS viewport_id, [4, 8, 12, 14, 16][k % 5 + 1] AS zoom, (w + 180) / 360 * 256 AS vl, (w + 0.25 + 180) / 360 * 256 AS vr,
    (0.5 - ln((1 + sin(radians(s + 0.1))) / (1 - sin(radians(s + 0.1)))) / (4 * pi())) * 256 AS vb,
    (0.5 - ln((1 + sin(radians(s))) / (1 - sin(radians(s)))) / (4 * pi())) * 256 AS vt
  FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, (89000000 + n_nationkey % 5 * 2500000) / 1e7 AS w, (479500000 + n_nationkey // 5 * 800000) / 1e7 AS s FROM nation)),
hits AS (
  SELECT viewport_id, zoom, route_id, first, last, CASE WHEN r <= vr AND l >= vl AND t <= vt AND b >= vb THEN 'INCLUSIVE' ELSE 'PARTIAL' END AS hit
  FROM v, boxes WHERE NOT (r < vl OR l > vr OR t < vb OR b > vt))"""
)


@query("j8_routes_in_viewport", _HITS + " SELECT viewport_id, zoom, route_id, first, last, hit FROM hits")
def routes_in_viewport(spark: SparkSession, sf: str) -> DataFrame:
    hits = polyline.routes_in_viewport(polyline.bounding_boxes(_pixels(spark, sf)), fx.viewports(spark, sf))
    return hits.select("viewport_id", "zoom", "route_id", "first", "last", "hit")


_RUNS = (
    _HITS
    + """, m AS (SELECT *, max(last) OVER (PARTITION BY viewport_id, route_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
f AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR first > reach THEN 1 ELSE 0 END) OVER (PARTITION BY viewport_id, route_id ORDER BY first, last) AS BIGINT) AS run FROM m),
runs AS (SELECT viewport_id, zoom, route_id, run, min(first) AS first, max(last) AS last FROM f GROUP BY viewport_id, zoom, route_id, run)"""
)


@query("w6_route_runs", _RUNS + " SELECT * FROM runs")
def route_runs(spark: SparkSession, sf: str) -> DataFrame:
    return polyline.route_runs(polyline.routes_in_viewport(polyline.bounding_boxes(_pixels(spark, sf)), fx.viewports(spark, sf)))


@query(
    "w6_drawn_points",
    _RUNS
    + ", "
    + _level_tables()
    + """ SELECT viewport_id, r.route_id, run, CAST(seq AS BIGINT) AS seq FROM runs r JOIN levels_of l ON l.route_id = r.route_id AND seq BETWEEN first AND last
WHERE min_zoom <= zoom OR seq IN (first, last)""",
)
def drawn_points(spark: SparkSession, sf: str) -> DataFrame:
    levels = cut(polyline.polyline_levels(fx.route_points(spark, sf)))
    runs = polyline.route_runs(polyline.routes_in_viewport(polyline.bounding_boxes(levels), fx.viewports(spark, sf)))
    return polyline.drawn_points(runs, levels).select("viewport_id", "route_id", "run", "seq")


@query(
    "a5_benchmark_average",
    fx.with_tables("runs")
    + """SELECT route, CAST(sum(ms) FILTER (WHERE rn > 1) AS BIGINT) // 5 AS mean_ms
FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY run) AS rn FROM runs) GROUP BY route HAVING count(*) = 6""",
)
def benchmark_average(spark: SparkSession, sf: str) -> DataFrame:
    return report.benchmark_average(fx.bench_runs(spark, sf))
