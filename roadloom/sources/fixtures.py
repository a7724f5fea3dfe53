"""Road graphs, requests, places and tracks derived from the given tables by integer arithmetic.

Each table has a function here and the same rows in DuckDB SQL, in ``SQL``.
"""

from __future__ import annotations

from math import floor, isqrt, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import Grid, grid_cell
from roadloom.session import cut, large, table
from roadloom.sources.graph_file import DETAIL_BYTES, EDGE_BYTES, MAGIC, NODE_RANGE, VERSION, GraphMeta, write_part

GRID = Grid(60_000_000, 470_000_000, 1_000_000, 1_000_000, 91, 81)
EDGE_ID_STEP = 1 << 20
#: Nodes of a block in the graph file.
BLOCK = NODE_RANGE
#: Blocks, and edges, that one task writes at a time.
BLOCKS_A_PART, EDGES_A_PART = 128, 1 << 19


def node_count(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "customer").count()


def top_level(n: int) -> int:
    return floor(log2(n)) - 3


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node_id, lon_e7, lat_e7, cell_id, is_core)``."""
    level = top_level(node_count(spark, sf_dir))
    key = F.col("c_custkey").cast("bigint")
    at = table(spark, sf_dir, "customer").select(
        key.alias("node_id"),
        (60_000_000 + (key * 7919 % 10007) * 9000).cast("int").alias("lon_e7"),
        (470_000_000 + (key * 104729 % 10009) * 8000).cast("int").alias("lat_e7"),
    )
    return at.withColumn("cell_id", grid_cell(F.col("lon_e7"), F.col("lat_e7"), GRID)).withColumn(
        "is_core", F.col("node_id") % (1 << level) == 0
    )


def _two_to(level: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(level))


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each level k, start a and direction d of the line graph's contraction hierarchy."""
    n = node_count(spark, sf_dir)
    level = top_level(n)
    i = F.col("c_custkey").cast("bigint")
    base = table(spark, sf_dir, "customer").where(i < n - 1).select(
        i.alias("i"),
        (1 + i * 37 % 101).alias("d0"),
        (1 + i * 53 % 97).alias("d1"),
        (10 + i % 7).alias("euclid"),
        F.explode(F.sequence(F.lit(0), F.lit(level))).alias("k"),
    )
    length = _two_to("k")
    start = F.col("i") - F.col("i") % length
    sums = base.groupBy("k", start.alias("a")).agg(
        F.sum("d0").alias("d0"), F.sum("d1").alias("d1"), F.sum("euclid").alias("euclid")
    )
    each = sums.withColumn("b", F.col("a") + length).where(F.col("b") <= n - 1)
    two = F.explode(F.array(F.lit(0), F.lit(1))).alias("d")
    return each.select("*", two, F.lit(level).alias("top"))


def _edge_id(k: Column, a: Column, d: Column) -> Column:
    return (k * EDGE_ID_STEP + a) * 2 + d


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(edge_id, owner, direction, src, dst, dist)``; core edges belong to their source."""
    src = F.when(F.col("d") == 0, F.col("a")).otherwise(F.col("b"))
    dst = F.when(F.col("d") == 0, F.col("b")).otherwise(F.col("a"))
    a_is_odd = F.col("a") % (2 * _two_to("k")) != 0
    owner = F.when(F.col("k") == F.col("top"), src).when(a_is_odd, F.col("a")).otherwise(F.col("b"))
    return _hierarchy(spark, sf_dir).select(
        _edge_id(F.col("k").cast("bigint"), F.col("a"), F.col("d")).alias("edge_id"),
        owner.alias("owner"),
        F.when(owner == src, "out").otherwise("in").alias("direction"),
        src.alias("src"),
        dst.alias("dst"),
        F.when(F.col("d") == 0, F.col("d0")).otherwise(F.col("d1")).alias("dist"),
    )


def edge_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(edge_id, euclid, shortcut1, shortcut2, shortcut_node)``; -1 marks a road edge."""
    k, a, d = F.col("k").cast("bigint"), F.col("a"), F.col("d")
    mid = a + F.shiftright(_two_to("k"), 1)
    halves = _edge_id(k - 1, a, d), _edge_id(k - 1, mid, d)
    none = F.lit(-1).cast("bigint")
    first = F.when(F.col("k") == 0, none).when(d == 0, halves[0]).otherwise(halves[1])
    second = F.when(F.col("k") == 0, none).when(d == 0, halves[1]).otherwise(halves[0])
    return _hierarchy(spark, sf_dir).select(
        _edge_id(k, a, d).alias("edge_id"),
        "euclid",
        first.alias("shortcut1"),
        second.alias("shortcut2"),
        F.when(F.col("k") == 0, none).otherwise(mid).alias("shortcut_node"),
    )


def general_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph without shortcuts, with loops and parallel edges; every node is core."""
    n, key = node_count(spark, sf_dir), F.col("o_orderkey").cast("bigint")
    src = F.col("o_custkey").cast("bigint")
    return table(spark, sf_dir, "orders").select(
        key.alias("edge_id"),
        src.alias("owner"),
        F.lit("out").alias("direction"),
        src.alias("src"),
        ((key * 31 + 7) % n).alias("dst"),
        (1 + key % 997).alias("dist"),
    )


def _dest(start: Column, key: Column, n: int) -> Column:
    """Mostly up to 61 nodes along the road, one way or the other; of every thousandth order anywhere."""
    off = 1 + key % 61
    ahead = ((key % 2 == 1) & (start + off < n)) | (start < off)
    return F.when(key % 1000 == 0, (key * 7919 + 13) % n).when(ahead, start + off).otherwise(start - off)


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every order."""
    n, key = node_count(spark, sf_dir), F.col("o_orderkey").cast("bigint")
    start = F.col("o_custkey").cast("bigint")
    return table(spark, sf_dir, "orders").select(key.alias("request_id"), start.alias("start_node"), _dest(start, key, n).alias("dest_node"))


def grid_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Width and height of the grid that the first customers fill."""
    n = node_count(spark, sf_dir)
    return isqrt(n), n // isqrt(n)


def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets of a grid, both ways and all of length 7, so that most paths have many of the same length; every node is core."""
    (w, h), i = grid_size(spark, sf_dir), F.col("c_custkey").cast("bigint")
    x, y = i % w, F.floor(i / w)
    ways = [(x < w - 1, i + 1), (x > 0, i - 1), (y < h - 1, i + w), (y > 0, i - w)]
    peers = F.array(*(F.struct(F.lit(d).cast("bigint").alias("d"), F.when(there, to).alias("dst")) for d, (there, to) in enumerate(ways)))
    each = table(spark, sf_dir, "customer").where(i < w * h).select(i.alias("src"), F.explode(peers).alias("p")).where("p.dst IS NOT NULL")
    return each.select(
        (F.col("p.d") * EDGE_ID_STEP + F.col("src")).alias("edge_id"), F.col("src").alias("owner"), F.lit("out").alias("direction"), "src", "p.dst", F.lit(7).cast("bigint").alias("dist")
    )


def grid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    (w, h), key = grid_size(spark, sf_dir), F.col("o_orderkey").cast("bigint")
    start, dest = F.col("o_custkey").cast("bigint") % (w * h), (key * 7919 + 13) % (w * h)
    return table(spark, sf_dir, "orders").select(key.alias("request_id"), start.alias("start_node"), dest.alias("dest_node"))


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("bigint")
    return table(spark, sf_dir, "part").select(
        key.alias("point_id"),
        (465_000_000 + (key * 15731 % 10009) * 9000).cast("int").alias("lat_e7"),
        (55_000_000 + (key * 31337 % 10007) * 10000).cast("int").alias("lon_e7"),
    )


def position_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, start, end)``: positions beside the nodes of the route requests."""
    shift = lambda c, by: (F.col(c) + F.col("node_id") % by * 100).cast("int").alias(c)
    at = nodes(spark, sf_dir).select("node_id", F.struct(shift("lat_e7", 7), shift("lon_e7", 5)).alias("at"))
    starts = at.select(F.col("node_id").alias("start_node"), F.col("at").alias("start"))
    ends = at.select(F.col("node_id").alias("dest_node"), F.col("at").alias("end"))
    asked = route_requests(spark, sf_dir)
    return asked.join(large(starts), "start_node").join(large(ends), "dest_node").select("request_id", "start", "end")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("bigint")
    lat = (465_000_000 + (key * 15731 % 10009) * 9000) / F.lit(1e7)
    lon = (55_000_000 + (key * 31337 % 10007) * 10000) / F.lit(1e7)
    texts, places = F.array("p_name", "p_brand", "p_type"), F.array(F.struct(lat.alias("lat"), lon.alias("lon")))
    return table(spark, sf_dir, "part").select(
        key.alias("item_id"),
        F.when(key % 23 == 0, F.slice(texts, 1, 0)).otherwise(texts).alias("strs"),
        F.when(key % 17 == 0, F.slice(places, 1, 0)).otherwise(places).alias("positions"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, q, lat_min, lat_max, lon_min, lon_max)``; the names are a few dozen, whatever the table's size."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    ranked = names.select((F.row_number().over(Window.orderBy("p_name")) - 1).cast("bigint").alias("query_id"), "p_name")
    half = F.floor(F.col("query_id") / 2)
    odd = F.col("query_id") % 2 == 1
    lon = (55_000_000 + half % 3 * 25_000_000) / F.lit(1e7)
    lat = (465_000_000 + half % 2 * 45_000_000) / F.lit(1e7)
    return ranked.select(
        "query_id",
        F.concat(F.lit("a "), "p_name").alias("q"),
        F.when(odd, lat).alias("lat_min"),
        F.when(odd, lat + 4.5).alias("lat_max"),
        F.when(odd, lon).alias("lon_min"),
        F.when(odd, lon + 5.0).alias("lon_max"),
    )


def gps_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, device_id, ts_ms, accuracy, lat, lon)``: slowly drifting tracks."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000
    event, user = F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint")
    at = table(spark, sf_dir, "events").select(
        event.alias("event_id"),
        user.alias("device_id"),
        F.floor(micros / 3_600_000).alias("ts_ms"),
        F.col("value").cast("double").alias("accuracy"),
    )
    ts, device, n = F.col("ts_ms"), F.col("device_id"), F.col("event_id")
    return at.select(
        "*",
        ((480_000_000 + ts * 5 + n * 37 % 100 * 1000) / F.lit(1e7)).alias("lat"),
        ((90_000_000 + device % 7 * 1_000_000 + ts * 7 + n % 10 * 300) / F.lit(1e7)).alias("lon"),
    )


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(route_id, seq, lat, lon)`` in degrees: each device's track in order of time."""
    order = Window.partitionBy("device_id").orderBy("ts_ms", "event_id")
    seq = (F.row_number().over(order) - 1).alias("seq")
    return gps_fixes(spark, sf_dir).select(F.col("device_id").alias("route_id"), seq, "lat", "lon")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(session_id, event_id, ts_ms, follow_gps, is_dragging, start, end, gps)``; positions may be null."""
    n = node_count(spark, sf_dir)
    kinds = table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("event_id"), "event_type")
    fixes = gps_fixes(spark, sf_dir).join(kinds, "event_id")
    at = nodes(spark, sf_dir).select("node_id", F.struct("lat_e7", "lon_e7").alias("at"))
    event = F.col("event_id")
    gps = F.struct(
        F.floor(F.col("lat") * 1e7 + 0.5).cast("int").alias("lat_e7"), F.floor(F.col("lon") * 1e7 + 0.5).cast("int").alias("lon_e7")
    )
    picked = fixes.withColumn("s", event % n).withColumn("e", (event * 31 + 7) % n)
    picked = picked.join(at.select(F.col("node_id").alias("s"), F.col("at").alias("sat")), "s", "left")
    picked = picked.join(at.select(F.col("node_id").alias("e"), F.col("at").alias("eat")), "e", "left")
    return picked.select(
        F.col("device_id").alias("session_id"),
        "event_id",
        "ts_ms",
        (event % 3 != 0).alias("follow_gps"),
        (event % 11 == 0).alias("is_dragging"),
        F.when(F.col("event_type") != "signup", F.col("sat")).alias("start"),
        F.when(~((F.col("event_type") == "view") & (event % 5 == 0)), F.col("eat")).alias("end"),
        F.when(F.col("event_type") != "error", gps).alias("gps"),
    )


def session_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The fixes of ``gps_fixes`` and changes of two sessions a device, as ``sessions.event_log`` takes them; ids are unique over both."""
    n = node_count(spark, sf_dir)
    fixes = gps_fixes(spark, sf_dir)
    event, kind = F.col("event_id"), F.col("event_id") % 7
    node = F.when(kind == 1, event % n).when(kind == 2, (event * 31 + 7) % n)
    changes = fixes.where(kind.between(1, 5)).select(
        (event * 2 + 1).alias("event_id"),
        "device_id",
        (F.col("device_id") * 2 + F.floor(event / 7) % 2).alias("session_id"),
        "ts_ms",
        F.element_at(F.array(*(F.lit(k) for k in ("start", "end", "follow", "drag", "gps_off"))), kind.cast("int")).alias("kind"),
        F.lit(None).cast("double").alias("accuracy"),
        (F.floor(event / 14) % 3 == 0).alias("flag"),
        F.when(F.floor(event / 7) % 5 != 3, node).alias("node_id"),
    )
    at = nodes(spark, sf_dir).select("node_id", "lat_e7", "lon_e7")
    return fixes.withColumn("event_id", event * 2), changes.join(at, "node_id", "left").drop("node_id")


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    zooms = F.array(*(F.lit(z) for z in (4, 8, 12, 14, 16)))
    left = (89_000_000 + k % 5 * 2_500_000) / F.lit(1e7)
    bottom = (479_500_000 + F.floor(k / 5) * 800_000) / F.lit(1e7)
    return table(spark, sf_dir, "nation").select(
        k.alias("viewport_id"),
        F.element_at(zooms, (k % 5 + 1).cast("int")).alias("zoom"),
        (bottom + 0.1).alias("lat_top"),
        bottom.alias("lat_bottom"),
        left.alias("lon_left"),
        (left + 0.25).alias("lon_right"),
    )


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(route, run, ms)``: a run for every order, six for most routes and seven for some."""
    key = F.col("o_orderkey").cast("bigint")
    return table(spark, sf_dir, "orders").select(F.floor(key * 10 / 61).alias("route"), key.alias("run"), (key * 31 % 500).alias("ms"))


def numbered_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Nodes and edges numbered as in a graph file: core nodes in blocks of their own, edges in order of owner and list.

    The number of the first core block comes third.
    """
    n = node_count(spark, sf_dir)
    level = top_level(n)
    low = n - 1 - (n - 1) // (1 << level)
    core_block = -(-low // BLOCK)

    def number(c: str) -> Column:
        node, step = F.col(c), 1 << level
        before = F.floor(node / step)
        return F.when(node % step == 0, core_block * BLOCK + before).otherwise(node - before - 1)

    at = nodes(spark, sf_dir).select(number("node_id").alias("node_id"), "lon_e7", "lat_e7")
    own = edges(spark, sf_dir).select("edge_id", *(number(c).alias(c) for c in ("owner", "src", "dst")), "direction", "dist")
    return at, numbered(own, "edge_id", "owner", F.col("direction").desc(), "edge_id"), core_block


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``rows`` with their number in ``order``, from 0, as column ``name``: ranges of rows are numbered side by side, each from the count of those before.

    The driver gets a number for each range. Rows that are equal in ``order`` may change places.
    """
    ranges = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before, sums = 0, []
    for here, n in sorted(tuple(r) for r in ranges.groupBy("_range").count().collect()):
        sums, before = [*sums, (here, before)], before + n
    start = F.create_map(*(F.lit(x).cast(kind) for pair in sums for x, kind in zip(pair, ("int", "bigint"), strict=True))) if sums else F.lit(None)
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn(name, (F.element_at(start, F.col("_range")) + number).cast("bigint") if sums else F.lit(0).cast("bigint")).drop("_range")


def block_chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int, int]:
    """``(blocks, nodes, cells, block_count)``: a block for each customer in chains of four, some of them broken in each way."""
    n = node_count(spark, sf_dir)
    cells, b = n // 4, F.col("c_custkey").cast("bigint")
    after = F.when(b % 97 == 5, b).when(b % 101 == 7, n + b).when((b % 113 == 11) & (b >= cells), b - cells)
    after = after.when((b % 89 == 3) & (b + cells + 1 < n), b + cells + 1).when(b + cells < n, b + cells).otherwise(-1)
    count = F.when(b % 107 == 2, 3).otherwise(2).cast("bigint")
    blocks = table(spark, sf_dir, "customer").select(b.alias("block"), after.alias("next_block"), count.alias("count"))
    cell = F.when(F.col("block") % 103 == 9, (F.col("block") + 1) % cells).otherwise(F.col("block") % cells)
    nodes = blocks.select(F.explode(F.array(F.col("block") * BLOCK, F.col("block") * BLOCK + 1)).alias("node_id"), cell.alias("cell_id"))
    return blocks, nodes, cells, n


def broken_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges and details of the hierarchy, with some that break each rule of a graph's tables."""
    n, e = node_count(spark, sf_dir), F.col("edge_id")
    own = edges(spark, sf_dir)
    own = own.select(
        "edge_id",
        "owner",
        F.when(e % 3 == 1, "in").otherwise(F.col("direction")).alias("direction"),
        F.when(e % 61 == 3, F.col("src") + n).otherwise(F.col("src")).alias("src"),
        F.when(e % 59 == 2, F.col("dst") + n).otherwise(F.col("dst")).alias("dst"),
        F.when(e % 53 == 1, -F.col("dist")).otherwise(F.col("dist")).alias("dist"),
    )
    details = edge_details(spark, sf_dir).where(e % 83 != 8)
    short = F.col("shortcut_node") != -1
    details = details.select(
        "edge_id",
        "euclid",
        F.when(short & (e % 73 == 6), -7).otherwise(F.col("shortcut1")).alias("shortcut1"),
        "shortcut2",
        F.when(short & (e % 79 == 7), F.col("shortcut_node") + 1).otherwise(F.col("shortcut_node")).alias("shortcut_node"),
    )
    return own.unionByName(own.where(e % 71 == 5)), details


def write_graph_file(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The numbered graph as a graph file in parts: input for the reader's queries and tests. Tasks write ranges of blocks and of edges."""
    at, own, core_block = (cut(x) if isinstance(x, DataFrame) else x for x in numbered_graph(spark, sf_dir))
    last, edge_count = at.agg(F.max("node_id")).first()[0], own.count()
    g, blocks = GRID, last // BLOCK + 1
    fields = (g.base_lon, g.base_lat, g.cell_width, g.cell_height, g.width, g.height, BLOCK, blocks, core_block, edge_count)
    meta = GraphMeta(*fields)
    coords_at, index_at, edges_at, details_at = meta.offsets
    write_part(path, 0, np.array([*MAGIC, VERSION, *fields], dtype=">i4").tobytes())
    group = F.floor(F.col("node_id") / (BLOCK * BLOCKS_A_PART)).alias("part")
    parts = spark.range(-(-blocks // BLOCKS_A_PART)).select(F.col("id").alias("part"))
    # of each range of blocks the edges before it; one row a range
    owned = cut(own.groupBy(F.col("owner").alias("node_id")).agg(*(F.count(F.when(F.col("direction") == d, 1)).alias(d) for d in ("out", "in"))).select("*", group))
    counts = dict(tuple(r) for r in owned.groupBy("part").agg(F.sum(F.col("out") + F.col("in"))).collect())
    before, first_edge = 0, {}
    for part in range(-(-blocks // BLOCKS_A_PART)):
        first_edge[part], before = before, before + counts.get(part, 0)

    def write_blocks(key: tuple, of: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        first = part * BLOCKS_A_PART
        count = min(BLOCKS_A_PART, blocks - first)
        held = nodes[nodes["kind"] == 0]
        block, slot = held["node_id"].to_numpy() // BLOCK - first, held["node_id"].to_numpy() % BLOCK
        coords = np.zeros((count, 1 + BLOCK, 2), dtype=">i4")
        coords[:, 0, 0] = -1
        coords[:, 0, 1] = np.bincount(block, minlength=count)
        coords[block, slot + 1] = held[["a", "b"]].to_numpy()
        write_part(path, coords_at + first * meta.block_bytes, coords.tobytes())
        # every node's out list ends where its in list starts, and that where the next node's out list does
        lists, edges_of = np.zeros(2 * count * BLOCK, dtype=np.int64), nodes[nodes["kind"] == 1]
        owner = edges_of["node_id"].to_numpy() - first * BLOCK
        lists[2 * owner], lists[2 * owner + 1] = edges_of["a"], edges_of["b"]
        ends = first_edge[part] + np.concatenate([[0], np.cumsum(lists)])
        index = np.zeros((count, 2 + 2 * BLOCK), dtype=">i4")
        for b in range(count):
            index[b, 1:] = ends[2 * b * BLOCK : 2 * (b + 1) * BLOCK + 1]
        write_part(path, index_at + first * meta.block_bytes, index.tobytes())
        return pd.DataFrame({"part": [part]})

    def write_edges(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("edge_id")
        first = int(key[0]) * EDGES_A_PART
        write_part(path, edges_at + first * EDGE_BYTES, rows[["peer", "dist"]].to_numpy().astype(">i4").tobytes())
        details = np.tile(np.array([0, -1, -1, -1], dtype=">i4"), (len(rows), 1))
        write_part(path, details_at + first * DETAIL_BYTES, details.tobytes())
        return pd.DataFrame({"part": [int(key[0])]})

    long = lambda c: F.col(c).cast("bigint")
    both = at.select("node_id", group, F.lit(0).alias("kind"), long("lon_e7").alias("a"), long("lat_e7").alias("b"))
    both = both.unionByName(owned.select("node_id", "part", F.lit(1).alias("kind"), long("out").alias("a"), long("in").alias("b")))
    parts.groupBy("part").cogroup(both.groupBy("part")).applyInPandas(write_blocks, "part bigint").count()
    peer = F.when(F.col("owner") == F.col("src"), F.col("dst")).otherwise(F.col("src")).alias("peer")
    records = own.select(F.floor(F.col("edge_id") / EDGES_A_PART).alias("part"), "edge_id", peer, "dist")
    records.groupBy("part").applyInPandas(write_edges, "part bigint").count()


#: The same tables in DuckDB, as common table expressions; each needs those named before it.
SQL = {
    "size": "size AS (SELECT count(*) AS n, CAST(floor(log2(count(*))) AS BIGINT) - 3 AS top FROM customer)",
    "nodes": """nodes AS (
  SELECT node_id, lon_e7, lat_e7,
    CAST(least(80, (lat_e7 - 470000000) // 1000000) * 91 + least(90, (lon_e7 - 60000000) // 1000000) AS INTEGER) AS cell_id,
    node_id % (1 << top) = 0 AS is_core
  FROM (SELECT CAST(c_custkey AS BIGINT) AS node_id,
      CAST(60000000 + (CAST(c_custkey AS BIGINT) * 7919 % 10007) * 9000 AS INTEGER) AS lon_e7,
      CAST(470000000 + (CAST(c_custkey AS BIGINT) * 104729 % 10009) * 8000 AS INTEGER) AS lat_e7
    FROM customer), size)""",
    "road": """road AS (
  SELECT CAST(c_custkey AS BIGINT) AS i, 1 + CAST(c_custkey AS BIGINT) * 37 % 101 AS d0,
    1 + CAST(c_custkey AS BIGINT) * 53 % 97 AS d1, 10 + CAST(c_custkey AS BIGINT) % 7 AS euclid
  FROM customer, size WHERE c_custkey < n - 1)""",
    "hierarchy": """levels AS (SELECT unnest(generate_series(0, top)) AS k FROM size),
spans AS (
  SELECT k, i // (1 << k) * (1 << k) AS a, CAST(sum(d0) AS BIGINT) AS d0, CAST(sum(d1) AS BIGINT) AS d1, CAST(sum(euclid) AS BIGINT) AS euclid
  FROM road, levels GROUP BY 1, 2),
hierarchy AS (
  SELECT s.*, a + (1 << k) AS b, d, top FROM spans s, (VALUES (0), (1)) t(d), size WHERE a + (1 << k) <= n - 1)""",
    "edges": """edges AS (
  SELECT edge_id, owner, CASE WHEN owner = src THEN 'out' ELSE 'in' END AS direction, src, dst, dist FROM (
    SELECT *, CASE WHEN k = top THEN src WHEN a % (2 << k) <> 0 THEN a ELSE b END AS owner FROM (
      SELECT (k * 1048576 + a) * 2 + d AS edge_id, k, top, a, b, CASE d WHEN 0 THEN a ELSE b END AS src,
        CASE d WHEN 0 THEN b ELSE a END AS dst, CASE d WHEN 0 THEN d0 ELSE d1 END AS dist FROM hierarchy)))""",
    "details": """details AS (
  SELECT edge_id, euclid, CASE WHEN k = 0 THEN -1 WHEN d = 0 THEN h0 ELSE h1 END AS shortcut1, CASE WHEN k = 0 THEN -1 WHEN d = 0 THEN h1 ELSE h0 END AS shortcut2,
    CASE WHEN k = 0 THEN -1 ELSE mid END AS shortcut_node
  FROM (SELECT *, (k * 1048576 + a) * 2 + d AS edge_id, ((k - 1) * 1048576 + a) * 2 + d AS h0, ((k - 1) * 1048576 + mid) * 2 + d AS h1
    FROM (SELECT *, a + (1 << k) // 2 AS mid FROM hierarchy)))""",
    "broken_graph": """once AS (
  SELECT edge_id, owner, CASE WHEN edge_id % 3 = 1 THEN 'in' ELSE direction END AS direction, CASE WHEN edge_id % 61 = 3 THEN src + n ELSE src END AS src,
    CASE WHEN edge_id % 59 = 2 THEN dst + n ELSE dst END AS dst, CASE WHEN edge_id % 53 = 1 THEN -dist ELSE dist END AS dist FROM edges, size),
bad_edges AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE edge_id % 71 = 5),
bad_details AS (
  SELECT edge_id, CASE WHEN shortcut_node <> -1 AND edge_id % 73 = 6 THEN -7 ELSE shortcut1 END AS shortcut1, shortcut2,
    CASE WHEN shortcut_node <> -1 AND edge_id % 79 = 7 THEN shortcut_node + 1 ELSE shortcut_node END AS shortcut_node
  FROM details WHERE edge_id % 83 <> 8)""",
    "block_chains": """blocks AS (
  SELECT b AS block, CASE WHEN b % 97 = 5 THEN b WHEN b % 101 = 7 THEN n + b WHEN b % 113 = 11 AND b >= cells THEN b - cells
      WHEN b % 89 = 3 AND b + cells + 1 < n THEN b + cells + 1 WHEN b + cells < n THEN b + cells ELSE -1 END AS next_block,
    CASE WHEN b % 107 = 2 THEN 3 ELSE 2 END AS held, CASE WHEN b % 103 = 9 THEN (b + 1) % cells ELSE b % cells END AS cell_id, n, cells
  FROM (SELECT CAST(c_custkey AS BIGINT) AS b, n, n // 4 AS cells FROM customer, size))""",
    "requests": """requests AS (
  SELECT request_id, start_node, CASE WHEN request_id % 1000 = 0 THEN (request_id * 7919 + 13) % n
      WHEN (request_id % 2 = 1 AND start_node + off < n) OR start_node < off THEN start_node + off ELSE start_node - off END AS dest_node
  FROM (SELECT CAST(o_orderkey AS BIGINT) AS request_id, CAST(o_custkey AS BIGINT) AS start_node, 1 + CAST(o_orderkey AS BIGINT) % 61 AS off FROM orders), size)""",
    "beside": """points AS (
  SELECT node_id AS point_id, CAST(lat_e7 + node_id % 7 * 100 AS INTEGER) AS lat_e7, CAST(lon_e7 + node_id % 5 * 100 AS INTEGER) AS lon_e7 FROM nodes)""",
    "snapped_requests": """asked AS (SELECT * FROM requests),
found AS (
  SELECT request_id, s.node_id AS start_node, t.node_id AS dest_node FROM asked JOIN snapped s ON s.point_id = start_node JOIN snapped t ON t.point_id = dest_node)""",
    "grid": """grid AS (SELECT w, n // w AS h FROM (SELECT n, CAST(floor(sqrt(n)) AS BIGINT) AS w FROM size)),
rides AS (
  SELECT request_id, s % w AS sx, s // w AS sy, t % w AS tx, t // w AS ty, w FROM (
    SELECT CAST(o_orderkey AS BIGINT) AS request_id, CAST(o_custkey AS BIGINT) % (w * h) AS s, (CAST(o_orderkey AS BIGINT) * 7919 + 13) % (w * h) AS t, w FROM orders, grid))""",
    "numbered": """low AS (SELECT *, 1 << top AS step, n - 1 - (n - 1) // (1 << top) AS below FROM size),
numbered AS (
  SELECT row_number() OVER (ORDER BY owner, direction DESC, edge_id) - 1 AS edge_id, owner, direction, src, dst, dist FROM (
    SELECT edge_id, direction, dist,
      CASE WHEN owner % step = 0 THEN (below + 1023) // 1024 * 1024 + owner // step ELSE owner - owner // step - 1 END AS owner,
      CASE WHEN src % step = 0 THEN (below + 1023) // 1024 * 1024 + src // step ELSE src - src // step - 1 END AS src,
      CASE WHEN dst % step = 0 THEN (below + 1023) // 1024 * 1024 + dst // step ELSE dst - dst // step - 1 END AS dst
    FROM edges, low))""",
    "lengths": """prefix AS (
  SELECT i + 1 AS node, CAST(sum(d0) OVER w AS BIGINT) AS p0, CAST(sum(d1) OVER w AS BIGINT) AS p1, CAST(sum(euclid) OVER w AS BIGINT) AS pe
  FROM road WINDOW w AS (ORDER BY i) UNION ALL SELECT 0, 0, 0, 0),
lengths AS (
  SELECT request_id, start_node, dest_node, abs(t.pe - s.pe) AS euclid,
    CASE WHEN dest_node >= start_node THEN t.p0 - s.p0 ELSE s.p1 - t.p1 END AS dist
  FROM requests JOIN prefix s ON s.node = start_node JOIN prefix t ON t.node = dest_node)""",
    "points": """points AS (
  SELECT CAST(p_partkey AS BIGINT) AS point_id, CAST(465000000 + (CAST(p_partkey AS BIGINT) * 15731 % 10009) * 9000 AS INTEGER) AS lat_e7,
    CAST(55000000 + (CAST(p_partkey AS BIGINT) * 31337 % 10007) * 10000 AS INTEGER) AS lon_e7
  FROM part)""",
    "snapped": """snapped AS (
  SELECT point_id, CAST(d[2] AS BIGINT) AS node_id, d[1] AS dist2 FROM (
    SELECT point_id, min([(CAST(p.lat_e7 AS BIGINT) - v.lat_e7) * (CAST(p.lat_e7 AS BIGINT) - v.lat_e7)
      + (CAST(p.lon_e7 AS BIGINT) - v.lon_e7) * (CAST(p.lon_e7 AS BIGINT) - v.lon_e7), node_id]) AS d
    FROM points p, nodes v GROUP BY point_id))""",
    "items": """items AS (
  SELECT CAST(p_partkey AS BIGINT) AS item_id,
    CASE WHEN p_partkey % 23 = 0 THEN [] ELSE [p_name, p_brand, p_type] END AS strs, p_partkey % 17 <> 0 AS placed,
    (465000000 + (CAST(p_partkey AS BIGINT) * 15731 % 10009) * 9000) / 1e7 AS lat,
    (55000000 + (CAST(p_partkey AS BIGINT) * 31337 % 10007) * 10000) / 1e7 AS lon
  FROM part)""",
    "queries": """queries AS (
  SELECT query_id, 'a ' || p_name AS q, CASE WHEN query_id % 2 = 1 THEN lat END AS lat_min, CASE WHEN query_id % 2 = 1 THEN lat + 4.5 END AS lat_max,
    CASE WHEN query_id % 2 = 1 THEN lon END AS lon_min, CASE WHEN query_id % 2 = 1 THEN lon + 5.0 END AS lon_max
  FROM (SELECT query_id, p_name, CAST((55000000 + query_id // 2 % 3 * 25000000) / 1e7 AS DOUBLE) AS lon,
      CAST((465000000 + query_id // 2 % 2 * 45000000) / 1e7 AS DOUBLE) AS lat
    FROM (SELECT row_number() OVER (ORDER BY p_name) - 1 AS query_id, p_name FROM (SELECT DISTINCT p_name FROM part))))""",
    "fixes": """fixes AS (
  SELECT event_id, device_id, ts_ms, accuracy, (480000000 + ts_ms * 5 + event_id * 37 % 100 * 1000) / 1e7 AS lat,
    (90000000 + device_id % 7 * 1000000 + ts_ms * 7 + event_id % 10 * 300) / 1e7 AS lon
  FROM (SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS device_id,
      (epoch_us(ts) - 1704067200000000) // 3600000 AS ts_ms, CAST(value AS DOUBLE) AS accuracy FROM events))""",
    "kept": """numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts_ms, event_id) AS rn FROM fixes),
folded AS (
  SELECT event_id, device_id, rn, ts_ms AS t, accuracy AS acc, TRUE AS keep FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.event_id, n.device_id, n.rn,
    CASE WHEN n.ts_ms - f.t < 10000 AND n.accuracy - f.acc < 5.0 THEN f.t ELSE n.ts_ms END,
    CASE WHEN n.ts_ms - f.t < 10000 AND n.accuracy - f.acc < 5.0 THEN f.acc ELSE n.accuracy END,
    NOT (n.ts_ms - f.t < 10000 AND n.accuracy - f.acc < 5.0)
  FROM folded f JOIN numbered n ON n.device_id = f.device_id AND n.rn = f.rn + 1),
kept AS (SELECT n.* EXCLUDE (rn) FROM numbered n JOIN folded f USING (event_id) WHERE f.keep)""",
    "sessions": """sessions AS (
  SELECT device_id AS session_id, f.event_id, ts_ms, f.event_id % 3 <> 0 AS follow_gps, f.event_id % 11 = 0 AS is_dragging,
    CASE WHEN event_type <> 'signup' THEN {'lat_e7': s.lat_e7, 'lon_e7': s.lon_e7} END AS start_at,
    CASE WHEN NOT (event_type = 'view' AND f.event_id % 5 = 0) THEN {'lat_e7': t.lat_e7, 'lon_e7': t.lon_e7} END AS end_at,
    CASE WHEN event_type <> 'error' THEN {'lat_e7': CAST(floor(lat * 1e7 + 0.5) AS INTEGER), 'lon_e7': CAST(floor(lon * 1e7 + 0.5) AS INTEGER)} END AS gps
  FROM (SELECT fixes.*, event_id % n AS s_id, (event_id * 31 + 7) % n AS t_id FROM fixes, size) f
    JOIN events e ON e.event_id = f.event_id JOIN nodes s ON s.node_id = s_id JOIN nodes t ON t.node_id = t_id)""",
    "session_log": """changes AS (
  SELECT event_id * 2 + 1 AS event_id, device_id, device_id * 2 + event_id // 7 % 2 AS session_id, ts_ms,
    ['start', 'end', 'follow', 'drag', 'gps_off'][event_id % 7] AS kind, event_id // 14 % 3 = 0 AS flag,
    CASE WHEN event_id // 7 % 5 <> 3 AND event_id % 7 <= 2 THEN {'lat_e7': lat_e7, 'lon_e7': lon_e7} END AS point
  FROM (SELECT *, CASE event_id % 7 WHEN 1 THEN event_id % n ELSE (event_id * 31 + 7) % n END AS node_id FROM fixes, size WHERE event_id % 7 BETWEEN 1 AND 5)
    JOIN nodes USING (node_id)),
timeline AS (
  SELECT event_id * 2 AS event_id, device_id, ts_ms, TRUE AS moves,
    {'lat_e7': CAST(floor(lat * 1e7 + 0.5) AS INTEGER), 'lon_e7': CAST(floor(lon * 1e7 + 0.5) AS INTEGER)} AS point FROM kept
  UNION ALL SELECT event_id, device_id, ts_ms, TRUE, NULL FROM changes WHERE kind = 'gps_off'),
log AS (
  SELECT session_id, device_id, ts_ms, event_id, kind, flag, point FROM changes WHERE kind <> 'gps_off'
  UNION ALL
  SELECT session_id, t.device_id, ts_ms, event_id, 'gps', NULL, point
  FROM timeline t JOIN (SELECT DISTINCT session_id, device_id FROM changes WHERE kind <> 'gps_off') s ON s.device_id = t.device_id)""",
    "runs": """runs AS (
  SELECT CAST(o_orderkey AS BIGINT) * 10 // 61 AS route, CAST(o_orderkey AS BIGINT) AS run, CAST(o_orderkey AS BIGINT) * 31 % 500 AS ms FROM orders)""",
}


def with_tables(*names: str, recursive: bool = False) -> str:
    """The ``WITH`` clause that defines the named tables, in the order given."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names) + "\n"
