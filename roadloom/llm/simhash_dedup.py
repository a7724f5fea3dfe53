"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import checkpointed, table
from roadloom.llm.components import connected_components

WORDS, SEED, RADIUS = 4, 42, 4
#: Rows of one table entry that are compared in one place; entries with more are cut into blocks.
HOT = 16384
#: Comparisons of two fingerprints that cost as much as a row of a table, rows a task, and comparisons held at once.
COMPARISONS_A_ROW, ROWS_A_TASK, HELD = 512, 100_000, 1 << 20
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_CHUNK = 200_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of a whole text: a bit is 1 where over half of the shingle hashes have it.

    A-Z become lower case; words are runs without ASCII white space; shingles
    count as often as they occur. Fewer words than a shingle: the whole sequence
    is one; no word (or null): 0.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    total = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, _CHUNK):
        part = tokens[at : at + _CHUNK + words - 1]
        shingles = zip(*(part[i:] for i in range(words))) if len(part) >= words else [part]
        hashes = np.array([digest(joined(s), SEED) for s in shingles], dtype="<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, into: str = "fp") -> DataFrame:
    """``docs`` with the column ``into``, the fingerprint's 64 bits as a signed long, for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column("text")]
            column = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, into])

    kept = docs.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.LongType())])
    return kept.mapInArrow(run, schema)


def segments_for(count: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """``(shift, width, ball radius)`` of each segment, chosen for ``count`` fingerprints.

    With radii that sum to ``radius - m + 1`` over m segments, two fingerprints
    within ``radius`` agree within the radius of at least one segment, whatever m
    is. m is the one with the fewest table rows and expected comparisons.
    """
    best: tuple[float, list[tuple[int, int, int]]] | None = None
    for m in range(1, radius + 2):
        spare, widths = radius - m + 1, [64 // m + (i < 64 % m) for i in range(m)]
        radii = [spare // m + (i < spare % m) for i in range(m)]
        cost = 0.0
        for w, r in zip(widths, radii, strict=True):
            wide, narrow = (sum(comb(w, k) for k in range(x + 1)) for x in _halves(r))
            cost += wide + wide * narrow * count / 2.0**w / COMPARISONS_A_ROW
        if best is None or cost < best[0]:
            best = cost, [(sum(widths[:i]), widths[i], radii[i]) for i in range(m)]
    assert best is not None
    return best[1]


def _halves(radius: int) -> tuple[int, int]:
    """Two values within ``radius`` have a third one within these of them."""
    return (radius + 1) // 2, radius // 2


def _ball(width: int, radius: int) -> list[int]:
    """All masks over ``width`` bits with at most ``radius`` ones, as signed longs, those with fewer first."""
    masks = (sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k))
    return [m - (m >> 63 << 64) for m in masks]


def _entries(seg: int, shift: int, width: int, radius: int) -> Column:
    """The table entries of a fingerprint in one segment: the values around its own, and whether they are on the narrow side too."""
    wide, narrow = (_ball(width, r) for r in _halves(radius))
    part = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND((1 << width) - 1) if width < 64 else F.col("fp")
    # widths are under 40 bits where there are several segments
    part = part.bitwiseXOR(seg << 40)
    masks = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(i < len(narrow)).alias("n")) for i, m in enumerate(wide)))
    return F.transform(masks, lambda x: F.struct(part.bitwiseXOR(x.m).alias("slot"), x.n.alias("narrow")))


def forest(prints: list[np.ndarray], radii: list[int], narrow: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the near pairs connect, of which at least one is ``narrow``: no more than rows.

    Near are two whose every fingerprint differs in at most its radius of bits.
    """

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.bitwise_count(prints[0][x, None] ^ prints[0][y]) <= radii[0]
        for p, r in zip(prints[1:], radii[1:], strict=True):
            if out.any():
                out &= np.bitwise_count(p[x, None] ^ p[y]) <= r
        return out

    n, every, found = len(narrow), np.arange(len(narrow)), []
    rows = np.flatnonzero(narrow)
    step = max(1, HELD // n)
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        met = near(own, every)
        met[np.arange(len(own)), own] = False
        if met.any():
            found += [own[met.any(axis=1)], np.flatnonzero(met.any(axis=0))]
    links: list[tuple[int, int]] = []
    left = np.unique(np.concatenate(found)) if found else every[:0]
    while len(left):
        open_, left = [int(left[0])], left[1:]
        while open_ and len(left):
            x = open_.pop()
            met = near(np.array([x]), left)[0]
            links += [(x, int(y)) for y in left[met]]
            open_ += left[met].tolist()
            left = left[~met]
    return links


def near_links(
    nodes: DataFrame, count: int, radius: int = RADIUS, hot: int = HOT, key: str = "fp", second: tuple[str, int] | None = None
) -> DataFrame:
    """Links ``(a, b)`` between values of ``key`` that connect just what all pairs of near ``nodes`` connect.

    Two of ``nodes(key, fp, ...)``, whose ``key`` is distinct, are near if ``fp`` differs in at most ``radius``
    bits and, with ``second``, that column in at most its number of bits too.

    Each segment is a table: a node enters it under the values of a small Hamming ball around its own (a
    segment's radius is shared between the two that meet, so 2 bits need balls of 1). Where nodes meet
    under a value, the complete distances are verified, and the links of a spanning forest go on: at
    most one for each row, however many pairs are near. Values that more than ``hot`` rows share are cut
    into blocks, and every pair of blocks meets in a place of its own.
    """
    names = ["fp", *([second[0]] if second else [])]
    radii, held = [radius, *([second[1]] if second else [])], list(dict.fromkeys([key, *names]))
    parts = segments_for(count, radius)
    entries = F.explode(F.concat(*(_entries(i, *p) for i, p in enumerate(parts)))).alias("at")
    rows = nodes.select(*held, entries).select(*held, "at.slot", "at.narrow")
    size = sum(len(_ball(w, _halves(r)[0])) for _, w, r in parts)
    crowded = checkpointed(rows.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("slot", F.ceil(F.col("n") / hot).cast("long").alias("blocks")))
    at = ["slot"]
    if not crowded.isEmpty():
        blocks = F.coalesce("blocks", F.lit(1).cast("long"))
        rows = rows.join(crowded, "slot", "left").withColumn("block", F.pmod(F.xxhash64(key), blocks))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        at = ["slot", "i", "j"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: dict[str, np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            for first, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if end - first > 1:
                    prints = [rows[c][first:end].view(np.uint64) for c in names]
                    ids = rows[key][first:end]
                    out += [(int(ids[x]), int(ids[y])) for x, y in forest(prints, radii, rows["narrow"][first:end])]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        columns = [*held, *at, "narrow"]
        waiting = {c: [] for c in columns}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            changed = np.zeros(batch.num_rows, dtype=bool)
            for c in at:
                changed[1:] |= own[c][1:] != own[c][:-1]
                changed[0] |= bool(waiting[c]) and waiting[c][-1][-1] != own[c][0]
            cuts = np.flatnonzero(changed)
            for c in columns:
                waiting[c].append(own[c])
            if len(cuts):
                rows = {c: np.concatenate(waiting[c]) for c in columns}
                cuts += len(rows["narrow"]) - batch.num_rows
                yield links(rows, np.concatenate([[0], cuts]))
                waiting = {c: [rows[c][cuts[-1] :]] for c in columns}
        if waiting["narrow"]:
            rows = {c: np.concatenate(waiting[c]) for c in columns}
            yield links(rows, np.array([0, len(rows["narrow"])]))

    dealt = rows.select(*held, *at, "narrow").repartition(1 + count * size // ROWS_A_TASK, *at).sortWithinPartitions(*at, key)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _groups(rows: DataFrame, radius: int) -> DataFrame:
    """``(fp, label)``: fingerprints of one component share a label."""
    distinct = checkpointed(rows.select("fp").distinct())
    labels = connected_components(near_links(distinct, distinct.count(), radius))
    return distinct.join(labels, F.col("fp") == F.col("id"), "left").select("fp", F.coalesce("label", "fp").alias("label"))


def simhash_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    Links are found between distinct fingerprints, so any number of exact copies
    counts once. ``component_id`` is the smallest doc_id reachable (null only if
    all ids there are null). Null and empty texts share the fingerprint 0. Repeated
    rows are kept; other columns play no part; an empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = checkpointed(fingerprints(slim, words).drop("text"))
    of = checkpointed(_groups(rows, radius))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(of, "fp")
    smallest = first.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows.join(of.join(smallest, "label").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
