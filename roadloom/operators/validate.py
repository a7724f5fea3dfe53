"""Rules that a graph's tables must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import BLOCK_BITS, split_node_id
from roadloom.session import cut, large


def validate_graph(nodes: DataFrame, edges: DataFrame, details: DataFrame, block_size: int | None = None, block_count: int | None = None) -> DataFrame:
    """``(rule, id)``: a row for each node or edge that breaks a rule; none for a sound graph.

    Core nodes own no in list; edge ids are distinct, and 0..count-1 where blocks are
    given, as are block numbers and slots; both ends of an edge exist; every edge has details; a shortcut's
    halves exist and lead over its middle node, and their lengths add up.
    """
    rows = []

    def broken(rule: str, df: DataFrame, column: str) -> None:
        rows.append(df.select(F.lit(rule).alias("rule"), F.col(column).cast("bigint").alias("id")))

    ids = large(nodes.select("node_id"))
    core = large(nodes).where("is_core").select(F.col("node_id").alias("owner"))
    broken("core_in_list", edges.where("direction = 'in'").join(core, "owner", "left_semi"), "edge_id")
    for end in ("src", "dst"):
        broken(f"{end}_missing", edges.join(ids, F.col(end) == F.col("node_id"), "left_anti"), "edge_id")
    broken("details_missing", edges.join(large(details), "edge_id", "left_anti"), "edge_id")
    broken("edge_twice", edges.groupBy("edge_id").count().where("count > 1"), "edge_id")
    broken("negative_length", edges.where("dist < 0"), "edge_id")
    short = details.where("shortcut_node <> -1")
    own = edges.select("edge_id", F.col("src").alias("s"), F.col("dst").alias("t"), "dist")
    a = edges.select(F.col("edge_id").alias("shortcut1"), F.col("src").alias("s1"), F.col("dst").alias("t1"), F.col("dist").alias("w1"))
    b = edges.select(F.col("edge_id").alias("shortcut2"), F.col("src").alias("s2"), F.col("dst").alias("t2"), F.col("dist").alias("w2"))
    chain = short.join(large(own), "edge_id").join(large(a), "shortcut1", "left").join(large(b), "shortcut2", "left")
    wrong = {
        "half_missing": "s1 IS NULL OR s2 IS NULL",
        "halves_apart": "s1 <> s OR t1 <> shortcut_node OR s2 <> shortcut_node OR t2 <> t",
        "halves_length": "w1 + w2 <> dist",
    }
    each = F.explode(F.array_compact(F.array(*(F.when(F.expr(rule), name) for name, rule in wrong.items())))).alias("rule")
    rows.append(chain.select(each, F.col("edge_id").cast("bigint").alias("id")))
    if block_count is not None or block_size is not None:
        count = edges.agg(F.count("*")).scalar()
        broken("edge_number", edges.where((F.col("edge_id") < 0) | (F.col("edge_id") >= count)), "edge_id")
    if block_count is not None:
        broken("block_number", nodes.where(split_node_id(F.col("node_id"))[0] >= block_count), "node_id")
    if block_size is not None:
        broken("slot_number", nodes.where(split_node_id(F.col("node_id"))[1] >= block_size), "node_id")
    return reduce(DataFrame.unionByName, rows)


def validate_ranges(ranges: DataFrame, block_size: int, edge_count: int) -> DataFrame:
    """``(rule, id)`` for a graph file's index ``ranges(owner, out_start, in_start, end)``.

    A node's out list starts no later than its in list, that no later than it ends, and the next
    node's no earlier than that; the last range ends at ``edge_count`` (the id is where it does end).
    """
    block, slot = split_node_id(F.col("owner"))
    follower = F.when(slot == block_size - 1, (block + 1) * (1 << BLOCK_BITS)).otherwise(F.col("owner") + 1)
    nodes = ranges.select(F.col("owner").alias("follower"), F.col("out_start").alias("then"))
    overlap = ranges.withColumn("follower", follower).join(nodes, "follower").where(F.col("then") < F.col("end"))
    backward = ranges.where("out_start > in_start OR in_start > end")
    last = ranges.agg(F.max("end").alias("last")).where(F.col("last") != edge_count)
    named = [("range_backward", backward, "owner"), ("range_overlap", overlap, "owner"), ("last_offset", last, "last")]
    return _named(named)


def _named(rows: list[tuple[str, DataFrame, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), F.col(c).cast("bigint").alias("id")) for rule, df, c in rows])


def chain_ends(blocks: DataFrame) -> DataFrame:
    """``(block, far, low, high)``: what each block's chain comes to, for ``blocks(block, next_block, low, high)``.

    ``low`` and ``high`` become the smallest and largest over the chain, and ``far`` is null for chains that end. In a chain
    that doesn't, ``far`` is a block of its cycle, and every block of a cycle is the ``far`` of one. Pointers
    double: after r rounds a block knows what 2^r steps lead to, so a chain of n blocks takes log2(n) joins.
    """
    links = cut(blocks.select("block", F.col("next_block").alias("far"), "low", "high"))
    steps, most = 1, links.count()
    while steps <= most and not links.where("far IS NOT NULL").isEmpty():
        ahead = links.select(F.col("block").alias("far"), F.col("far").alias("farther"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        # chains that have ended don't move any more, so they share no key
        going = links.where("far IS NOT NULL").join(ahead, "far", "left")
        going = going.select("block", F.col("farther").alias("far"), F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high"))
        links, steps = cut(going.unionByName(links.where("far IS NULL"))), steps * 2
    return links


def validate_chains(blocks: DataFrame, nodes: DataFrame, cells: int, block_count: int, block_size: int) -> DataFrame:
    """``(rule, id)``: a row for each block or cell that breaks a rule of a grid's block chains.

    ``blocks(block, next_block, count)`` are a graph file's block headers, ``nodes(node_id, cell_id)`` its nodes. The first ``cells`` blocks
    start the cells' chains, and -1 ends one. A next block exists; a block has as many nodes as fit; no chain comes back to itself (a row
    for each block of a cycle); a block follows one block at most, and none if it starts a chain; every block lies on a cell's chain; and a cell's chain
    holds nodes of that cell alone (the id is the cell's).
    """
    known = F.col("next_block").between(0, block_count - 1)
    own = nodes.groupBy(split_node_id(F.col("node_id"))[0].alias("block")).agg(F.min("cell_id").alias("low"), F.max("cell_id").alias("high"))
    linked = cut(blocks.select("block", F.when(known, F.col("next_block")).alias("next_block")).join(own, "block", "left"))
    ends = cut(chain_ends(linked))
    cycle = ends.where("far IS NOT NULL").select(F.col("far").alias("block")).distinct()
    follows = linked.where("next_block IS NOT NULL").groupBy(F.col("next_block").alias("block")).agg(F.count("*").alias("n"))
    shared = follows.where((F.col("n") > 1) | (F.col("block") < cells))
    reached = _reached(linked.where(F.col("block") < cells).select("block"), linked)
    mixed = ends.where(F.col("block") < cells).where("low < block OR high > block")
    wrong = blocks.where((F.col("next_block") < -1) | (F.col("next_block") >= block_count))
    return _named(
        [
            ("next_block", wrong, "block"),
            ("node_count", blocks.where((F.col("count") < 0) | (F.col("count") > block_size)), "block"),
            ("block_cycle", cycle, "block"),
            ("block_shared", shared, "block"),
            ("block_unreachable", blocks.join(reached, "block", "left_anti"), "block"),
            ("cell_mixed", mixed, "block"),
        ]
    )


def _reached(heads: DataFrame, linked: DataFrame) -> DataFrame:
    """Blocks on the chains of ``heads``: each round adds what the blocks so far lead to in twice as many steps."""
    jump = cut(linked.where("next_block IS NOT NULL").select("block", F.col("next_block").alias("far")))
    seen, known = cut(heads), heads.count()
    while True:
        seen = cut(seen.unionByName(seen.join(jump, "block").select(F.col("far").alias("block"))).distinct())
        now = seen.count()
        if now == known:
            return seen
        known = now
        jump = cut(jump.join(jump.select(F.col("block").alias("far"), F.col("far").alias("farther")), "far").select("block", F.col("farther").alias("far")))
