"""Chains of blocks in graph files."""

import random
from collections import Counter

from roadloom.functions.geo import BLOCK_BITS
from roadloom.operators import validate
from roadloom.sources import fixtures as fx
from roadloom.sources.graph_file import read_blocks, read_graph_file, read_meta


def _plain(links, cells, count, size, counts, cell_of):
    found = set()
    after = {b: n for b, n in links.items() if 0 <= n < count}
    found |= {("next_block", b) for b, n in links.items() if n < -1 or n >= count}
    found |= {("node_count", b) for b, n in counts.items() if n > size or n < 0}
    seen = set()
    for head in links:
        way, at = [], head
        while at is not None and at not in way:
            way.append(at)
            at = after.get(at)
        if at == head:
            found.add(("block_cycle", head))
        if head < cells:
            seen |= set(way)
            if any(cell_of[b] != head for b in way):
                found.add(("cell_mixed", head))
    found |= {("block_unreachable", b) for b in links if b not in seen}
    into = list(after.values())
    return found | {("block_shared", b) for b in set(into) if into.count(b) > 1 or b < cells}


def test_chains_by_walking_them(spark):
    r = random.Random(5)
    for cells in (3, 12):
        count = 40
        links = {b: r.choice([-1, b + cells, b + cells, b + cells, r.randrange(-3, count + 3)]) for b in range(count)}
        links = {b: n if n < count + 3 else -1 for b, n in links.items()}
        counts = {b: r.randrange(0, 5) for b in links}
        cell_of = {b: b % cells if r.random() < 0.9 else r.randrange(cells) for b in links}
        blocks = spark.createDataFrame([(b, n, counts[b]) for b, n in links.items()], "block long, next_block long, count long")
        nodes = spark.createDataFrame([((b << BLOCK_BITS) + 1, c) for b, c in cell_of.items()], "node_id long, cell_id long")
        got = {tuple(x) for x in validate.validate_chains(blocks, nodes, cells, count, 3).collect()}
        assert got == _plain(links, cells, count, 3, counts, cell_of)


def test_one_long_chain_and_one_long_cycle(spark):
    """A thousand blocks in one chain take about ten rounds; a cycle of as many ends too."""
    n = 1000
    own = [(b << BLOCK_BITS, 0) for b in range(n)]
    nodes = spark.createDataFrame(own, "node_id long, cell_id long")
    for last, rules in ((-1, set()), (0, {"block_cycle", "block_shared"})):
        blocks = spark.createDataFrame([(b, b + 1 if b + 1 < n else last, 1) for b in range(n)], "block long, next_block long, count long")
        got = [tuple(x) for x in validate.validate_chains(blocks, nodes, 1, n, 1).collect()]
        assert {r for r, _ in got} == rules and sum(r == "block_cycle" for r, _ in got) == (n if rules else 0)


def test_headers_of_a_file(spark, sf, tmp_path):
    path = str(tmp_path / "g.graph")
    fx.write_graph_file(spark, sf, path)
    meta, rows = read_meta(path), read_blocks(spark, path).collect()
    assert [r.block for r in sorted(rows)] == list(range(meta.block_count)) and {r.next_block for r in rows} == {-1}
    assert sum(r["count"] for r in rows) == fx.node_count(spark, sf)


def test_a_file_in_parts(spark, sf, tmp_path, monkeypatch):
    """Tasks write the file side by side; reads across parts give what one part for each section gives."""
    whole, parts = str(tmp_path / "whole.graph"), tmp_path / "parts.graph"
    fx.write_graph_file(spark, sf, whole)
    rows = [Counter(map(tuple, t.collect())) for t in read_graph_file(spark, whole)[1:]]
    monkeypatch.setattr(fx, "BLOCKS_A_PART", 1)
    monkeypatch.setattr(fx, "EDGES_A_PART", 7)
    fx.write_graph_file(spark, sf, str(parts))
    assert max(p.stat().st_size for p in parts.iterdir() if p.name.isdigit()) <= (2 + 2 * fx.BLOCK) * 4
    assert [Counter(map(tuple, t.collect())) for t in read_graph_file(spark, str(parts))[1:]] == rows
