"""Graph files of fixed binary layout into tables, read in parallel by byte ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import NAMESPACE_URL, uuid5

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.geo import Grid, grid_cell, is_core
from roadloom.operators.graph import edge_endpoints
from roadloom.session import large

# Fixed values of the format: magic words, version, and the order of the header's 13 big-endian int32.
MAGIC = (0x4348474F, 0x66665450)
VERSION = 1
FIELDS = ("base_lon", "base_lat", "cell_width", "cell_height", "grid_width", "grid_height", "block_size", "block_count", "core_block", "edge_count")
PAGE, NODE_RANGE, EDGE_BYTES, DETAIL_BYTES = 4096, 1024, 8, 16
_EDGES_A_TASK, _BLOCKS_A_TASK = 1 << 20, 256


@dataclass(frozen=True)
class GraphMeta:
    base_lon: int
    base_lat: int
    cell_width: int
    cell_height: int
    grid_width: int
    grid_height: int
    block_size: int
    block_count: int
    core_block: int
    edge_count: int

    @property
    def grid(self) -> Grid:
        return Grid(self.base_lon, self.base_lat, self.cell_width, self.cell_height, self.grid_width, self.grid_height)

    @property
    def block_bytes(self) -> int:
        return (1 + self.block_size) * 8

    @property
    def offsets(self) -> tuple[int, int, int, int]:
        """Where coordinates, edge index, edges and edge details start; sections begin on whole pages."""
        whole = lambda x: -(-x // PAGE) * PAGE
        coords = PAGE
        index = whole(coords + self.block_count * self.block_bytes)
        edges = whole(index + self.block_count * self.block_bytes)
        return coords, index, edges, whole(edges + self.edge_count * EDGE_BYTES)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(path: str, start: int, length: int) -> bytes:
    """Bytes of a file by local path or URI; also of a folder that holds the file in parts, each named by its first byte's number (``write_part``)."""
    files, at = _located(path)
    if files.get_file_info(at).type != fs.FileType.Directory:
        with files.open_input_file(at) as f:
            return f.read_at(length, start)
    parts = sorted((int(p.base_name), p.size, p.path) for p in files.get_file_info(fs.FileSelector(at)) if p.base_name.isdigit())
    out = bytearray()
    for first, size, part in parts:
        here = start + len(out)
        if len(out) < length and first <= here < first + size:
            with files.open_input_file(part) as f:
                out += f.read_at(min(first + size - here, length - len(out)), here - first)
    return bytes(out)


def write_part(path: str, first: int, data: bytes) -> None:
    """A part of the graph file that the folder ``path`` holds; tasks write theirs side by side, another try writes the same again."""
    files, at = _located(path)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/{first:020d}") as f:
        f.write(data)


def read_meta(path: str) -> GraphMeta:
    """The header; another magic word or version raises ``ValueError``."""
    words = np.frombuffer(_read(path, 0, 52), dtype=">i4").tolist()
    if len(words) < 13 or tuple(words[:2]) != MAGIC:
        raise ValueError("not a graph file")
    if words[2] != VERSION:
        raise ValueError(f"graph file version {words[2]}")
    return GraphMeta(*words[3:])


def _ranges(spark: SparkSession, count: int, step: int) -> DataFrame:
    tasks = max(1, -(-count // step))
    return spark.range(0, tasks, 1, tasks).select((F.col("id") * step).alias("first"), F.least((F.col("id") + 1) * step, F.lit(count)).alias("end"))


def _mapped(ranges: DataFrame, decode: Callable[[int, int], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, end in zip(b["first"].tolist(), b["end"].tolist(), strict=True):
                if end > first:
                    yield decode(first, end)

    return ranges.mapInPandas(run, schema)


def decode_blocks(data: bytes, first: int, block_size: int) -> pd.DataFrame:
    """Nodes of consecutive blocks: ``next block, count``, then longitude and latitude of each node."""
    words = np.frombuffer(data, dtype=">i4").reshape(-1, 1 + block_size, 2)
    counts = words[:, 0, 1]
    if (counts > block_size).any():
        raise ValueError("a block holds more nodes than the block size")
    block, slot = np.nonzero(np.arange(block_size) < counts[:, None])
    at = words[block, slot + 1]
    return pd.DataFrame({"node_id": (block + first) * NODE_RANGE + slot, "lon_e7": at[:, 0].astype(np.int32), "lat_e7": at[:, 1].astype(np.int32)})


def decode_index(data: bytes, first: int, block_size: int, block_count: int) -> pd.DataFrame:
    """Each node's edge ranges: out edges from ``out_start`` to ``in_start``, in edges on to the next node's start."""
    words = np.frombuffer(data, dtype=">i4").astype(np.int64).reshape(-1, 1 + block_size, 2)
    blocks = np.arange(first, first + len(words))
    # the pair after a block's reserved word starts with its first node; the last word closes the last range
    flat = words.reshape(len(words), -1)[:, 1:]
    out_start, in_start, end = flat[:, 0:-1:2], flat[:, 1::2], flat[:, 2::2]
    if (out_start > in_start).any() or (in_start > end).any():
        raise ValueError("edge ranges run backward")
    ids = blocks[:, None] * NODE_RANGE + np.arange(block_size)
    return pd.DataFrame({"owner": ids.ravel(), "out_start": out_start.ravel(), "in_start": in_start.ravel(), "end": end.ravel()})


def read_graph_file(spark: SparkSession, path: str) -> tuple[GraphMeta, DataFrame, DataFrame, DataFrame]:
    """``(meta, nodes, edges, edge_details)`` of a graph file.

    Tasks read byte ranges of whole blocks or records, so no task holds the file.
    Chained blocks belong to the cell whose number starts the chain; the cell follows
    from the coordinates. Without a core block no node is core.
    """
    meta = read_meta(path)
    coords, index, edges_at, details_at = meta.offsets
    size, block_bytes = meta.block_size, meta.block_bytes

    def nodes_of(first: int, end: int) -> pd.DataFrame:
        return decode_blocks(_read(path, coords + first * block_bytes, (end - first) * block_bytes), first, size)

    def index_of(first: int, end: int) -> pd.DataFrame:
        return decode_index(_read(path, index + first * block_bytes, (end - first) * block_bytes), first, size, meta.block_count)

    def edges_of(first: int, end: int) -> pd.DataFrame:
        words = np.frombuffer(_read(path, edges_at + first * EDGE_BYTES, (end - first) * EDGE_BYTES), dtype=">i4").astype(np.int64)
        return pd.DataFrame({"edge_id": np.arange(first, end), "peer": words[::2], "dist": words[1::2]})

    def details_of(first: int, end: int) -> pd.DataFrame:
        words = np.frombuffer(_read(path, details_at + first * DETAIL_BYTES, (end - first) * DETAIL_BYTES), dtype=">i4").astype(np.int64)
        names = ("euclid", "shortcut1", "shortcut2", "shortcut_node")
        return pd.DataFrame({"edge_id": np.arange(first, end)} | {n: words[i::4] for i, n in enumerate(names)})

    blocks, records = _ranges(spark, meta.block_count, _BLOCKS_A_TASK), _ranges(spark, meta.edge_count, _EDGES_A_TASK)
    core = is_core(F.col("node_id"), meta.core_block)
    nodes = _mapped(blocks, nodes_of, "node_id bigint, lon_e7 int, lat_e7 int")
    nodes = nodes.withColumn("cell_id", grid_cell(F.col("lon_e7"), F.col("lat_e7"), meta.grid)).withColumn("is_core", core)
    owners = _mapped(blocks, index_of, "owner bigint, out_start bigint, in_start bigint, end bigint")
    lists = F.array(
        F.struct(F.lit("out").alias("direction"), F.col("out_start").alias("a"), F.col("in_start").alias("b")),
        F.struct(F.lit("in").alias("direction"), F.col("in_start").alias("a"), F.col("end").alias("b")),
    )
    lists = owners.select("owner", F.explode(lists).alias("l")).where("l.b > l.a")
    owned = lists.select("owner", "l.direction", F.explode(F.sequence("l.a", F.col("l.b") - 1)).alias("edge_id"))
    pairs = _mapped(records, edges_of, "edge_id bigint, peer bigint, dist bigint")
    edges = edge_endpoints(owned.join(large(pairs), "edge_id")).select("edge_id", "owner", "direction", "src", "dst", "dist")
    details = _mapped(records, details_of, "edge_id bigint, euclid bigint, shortcut1 bigint, shortcut2 bigint, shortcut_node bigint")
    return meta, nodes, edges, details


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(block, next_block, count)``: the header of each block of a graph file, as it stands; -1 ends a chain."""
    meta = read_meta(path)
    at, size = meta.offsets[0], meta.block_bytes

    def heads(first: int, end: int) -> pd.DataFrame:
        words = np.frombuffer(_read(path, at + first * size, (end - first) * size), dtype=">i4").reshape(end - first, -1)
        return pd.DataFrame({"block": np.arange(first, end), "next_block": words[:, 0].astype(np.int64), "count": words[:, 1].astype(np.int64)})

    return _mapped(_ranges(spark, meta.block_count, _BLOCKS_A_TASK), heads, "block bigint, next_block bigint, count bigint")


#: What each table's files are laid out by, and in which order a file's rows lie.
LAYOUT = {"nodes": (["node_id"], "cell_id"), "edges": (["direction", "owner"], "owner"), "edge_details": (["edge_id"], "edge_id")}


def write_graph_tables(tables: dict[str, DataFrame], folder: str, buckets: int | None = None) -> None:
    """Writes nodes by id, edges by list and owner, details by id, in ``buckets`` of the key's hash, one file each.

    Joins on these keys read the files as they lie and move only the other side (``load_graph_tables``). Without a number
    there are as many buckets as the session's shuffles have partitions; with fewer than that, Spark may shuffle both sides.
    ``folder`` mustn't hold tables already.
    """
    spark = tables["edges"].sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, (keys, order) in LAYOUT.items():
        rows = tables[name].repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(order)
        rows.option("path", f"{folder}/{name}").saveAsTable(_table_name(folder, name))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/layout")


def load_graph_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of ``write_graph_tables``, also in a session that didn't write them: it learns their layout from the folder."""
    buckets = spark.read.parquet(f"{folder}/layout").first()[0]
    for name, (keys, order) in LAYOUT.items():
        if not spark.catalog.tableExists(_table_name(folder, name)):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{folder}/{name}").schema)
            spark.sql(
                f"CREATE TABLE {_table_name(folder, name)} ({columns}) USING parquet "
                f"CLUSTERED BY ({', '.join(keys)}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{folder}/{name}'"
            )
    return {name: spark.table(_table_name(folder, name)) for name in LAYOUT}


def _table_name(folder: str, name: str) -> str:
    return f"graph_{uuid5(NAMESPACE_URL, folder).hex}_{name}"
