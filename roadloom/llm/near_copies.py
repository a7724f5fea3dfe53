"""Near copies of texts: SimHash candidates by multi-index hashing, verified by the similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import checkpointed, written
from roadloom.llm.components import connected_components
from roadloom.llm.simhash_dedup import near_links

#: Two documents are near copies where their sets of five-word shingles have a Jaccard similarity of 4/5 or more.
WORDS, SEED = 5, 42
#: Candidates differ in at most so many of the 64 bits of a SimHash of their words, and of a second one.
RADIUS, SECOND_RADIUS = 8, 12
#: Texts of one group are compared in blocks of so many, or of so many bytes.
TEXTS_A_BLOCK, BYTES_A_BLOCK = 4096, 8 << 20
_KNOWN, _CHUNK = 300_000, 100_000
_KEY = ["_none", "_doc", "_hash"]


class _WordHashes(dict):
    """XXH64 of words, kept for the next time; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def word_hashes(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The hash of each word in order; A-Z become lower case, words are runs without ASCII white space."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(known.__getitem__, tokens), dtype="<u8", count=len(tokens))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; fewer words: the whole sequence is one; none: none."""
    n = len(words)
    if not n:
        return np.empty(0, dtype="<u8")
    runs = max(1, n - size + 1)
    out = np.zeros(runs, dtype="<u8")
    for i in range(min(size, n)):
        out = _mixed(out + np.uint64(0x9E3779B97F4A7C15)) ^ words[i : i + runs]
    return np.unique(_mixed(out))


def majority_bits(hashes: np.ndarray) -> int:
    """SimHash: the bits that over half of the hashes have, as a signed long."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def signature(text: str | None, known: dict[bytes, int]) -> tuple[int, int, int]:
    """Id of the set of shingles, and two SimHashes of the set of words."""
    words = word_hashes(text, known)
    own = np.unique(words)
    set_id = xxhash.xxh64_intdigest(shingles(words).tobytes(), SEED)
    return set_id - (set_id >> 63 << 64), majority_bits(own), majority_bits(_mixed(own))


class Overlaps:
    """How many elements sets have in common, looked up by element."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        elements, owner = np.concatenate([*sets, np.empty(0, "<u8")]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(elements, kind="stable")
        self.owner = owner[order]
        first = np.append(True, elements[order][1:] != elements[order][:-1])[: len(order)]
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(first) - 1
        self.numbers = np.split(number, np.cumsum(self.sizes)[:-1]) if sets else []
        self.starts = np.append(np.flatnonzero(first), len(order))

    def similar(self, x: int) -> np.ndarray:
        """Of every set, whether its Jaccard similarity with set ``x`` is 4/5 or more, in whole numbers."""
        own = self.numbers[x]
        lengths = self.starts[own + 1] - self.starts[own]
        # places of all owners of the set's elements, list after list
        at = np.repeat(self.starts[own] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return 9 * both >= 4 * (self.sizes + self.sizes[x])


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with what tells its different ``(doc_id, text)`` apart."""
    doc = F.col("doc_id").cast("long")
    return docs.withColumns({"_none": doc.isNull(), "_doc": F.coalesce(doc, F.lit(0)), "_hash": F.xxhash64("text")})


def signed(docs: DataFrame) -> DataFrame:
    """``(_none, _doc, _hash, set, fp, fp2, bytes)`` of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            found = [signature(t.as_py(), known) for t in batch.column("text")]
            made = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), *made, batch.column("bytes")], [*_KEY, "set", "fp", "fp2", "bytes"])

    slim = _keyed(docs).select(*_KEY, "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return slim.mapInArrow(run, "_none boolean, _doc long, _hash long, set long, fp long, fp2 long, bytes long")


def candidate_groups(sets: DataFrame) -> DataFrame:
    """``sets(set, fp, fp2, ...)`` of groups of two and more, with ``group``, and ``n`` and ``size`` of the group.

    Groups are what links between near fingerprints connect.
    """
    node = F.xxhash64("fp", "fp2")
    nodes = checkpointed(sets.select(node.alias("id"), "fp", "fp2").dropDuplicates(["id"]))
    links = near_links(nodes, nodes.count(), RADIUS, key="id", second=("fp2", SECOND_RADIUS))
    labels = connected_components(links).select(F.col("id").alias("node"), "label")
    of = checkpointed(sets.withColumn("node", node).join(labels, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label", "node"))
    several = of.groupBy("group").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).where("n > 1")
    return of.join(written(several, "groups"), "group")


def _verified(group: pa.Table) -> pa.Table:
    """Links that connect what the near copies of one pair of blocks connect: fewer than texts."""
    known, rows = _WordHashes(), {}
    for own, fp, fp2, text in zip(*(group.column(c) for c in ("set", "fp", "fp2", "text")), strict=True):
        if own.as_py() not in rows:
            rows[own.as_py()] = (fp.as_py(), fp2.as_py(), shingles(word_hashes(text.as_py(), known)))
    ids = np.array(sorted(rows), dtype=np.int64)
    # bits of signed numbers would be those of their absolute values
    fp, fp2 = (np.array([rows[i][k] for i in ids.tolist()], dtype=np.int64).view(np.uint64) for k in (0, 1))
    overlaps = Overlaps([rows.pop(i)[2] for i in ids.tolist()])
    links, left = [], np.arange(len(ids))
    while len(left):
        open_, left = [int(left[0])], left[1:]
        while open_ and len(left):
            x = open_.pop()
            near = (np.bitwise_count(fp[left] ^ fp[x]) <= RADIUS) & (np.bitwise_count(fp2[left] ^ fp2[x]) <= SECOND_RADIUS)
            if near.any():
                near &= overlaps.similar(x)[left]
                links += [(int(ids[x]), int(y)) for y in ids[left[near]]]
                open_ += left[near].tolist()
                left = left[~near]
    return pa.table([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(set, label)`` of the sets of ``rows`` (as ``signed`` gives them) that links connect with others.

    Linked are sets whose fingerprints are near and whose similarity is 4/5 or more. One text of each set
    in a candidate group is fetched; groups are cut into blocks of a bounded size, and every pair of blocks
    is compared by itself.
    """
    rank = F.min(F.struct(*_KEY, "fp", "fp2", "bytes")).alias("r")
    sets = checkpointed(rows.groupBy("set").agg(rank).select("set", *(F.col(f"r.{c}").alias(c) for c in (*_KEY, "fp", "fp2", "bytes"))))
    blocks = (1 + F.greatest(F.floor(F.col("n") / TEXTS_A_BLOCK), F.floor(F.col("size") / BYTES_A_BLOCK))).cast("long")
    several = candidate_groups(sets).select("set", "group", "fp", "fp2", *_KEY, blocks.alias("blocks"))
    several = written(several.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks"))), "candidates")
    # merged whatever the size, so that a small table is no special case
    texts = _keyed(docs.select("doc_id", "text")).join(several.hint("merge"), _KEY).select("set", "group", "fp", "fp2", "block", "blocks", "text")
    each = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    links = checkpointed(each.groupBy("group", "i", "j").applyInArrow(_verified, "a long, b long"))
    return connected_components(links).select(F.col("id").alias("set"), "label")


def _least(columns: list[str]) -> Column:
    return F.min(F.struct(*columns)).alias("r")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: the one with the smallest doc_id, null ids last.

    Rows are copies if they have the same set of shingles (so all without a word are), or through links
    between similar sets. Of repeated rows that differ in other columns only, the smallest stays.
    Columns named like the stage's own (a leading ``_``) aside, names don't matter; an empty table stays empty.
    """
    rows = checkpointed(signed(docs))
    labels = near_groups(docs, rows)
    firsts = rows.groupBy("set").agg(_least(_KEY)).join(labels, "set", "left").groupBy(F.coalesce("label", "set")).agg(_least(["r"]))
    keep = firsts.select(*(F.col(f"r.r.{c}").alias(c) for c in _KEY))
    keys = rows.groupBy(*_KEY).agg((F.count("*") > 1).alias("_again"))
    kept = keep.withColumn("_kept", F.lit(True))
    marks = keys.join(kept, _KEY, "left").where("_again OR _kept IS NULL").select(*_KEY, F.col("_kept").isNotNull().alias("_kept"))
    marks = written(marks, "marks")
    # merged whatever the size; rows that repeat are there in both, and few
    found = _keyed(docs).join(marks.hint("merge"), _KEY, "left").where("_kept IS NULL OR _kept")
    again = found.where("_kept").groupBy(*_KEY).agg(_least(docs.columns))
    if marks.where("_kept").isEmpty():
        return found.select(docs.columns)
    return found.where("_kept IS NULL").select(docs.columns).union(again.select(*(F.col("r")[c].alias(c) for c in docs.columns)))
