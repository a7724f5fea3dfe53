"""Byte-level BPE over whole texts by a table of distinct words, and decoding by an id-to-piece join."""

from __future__ import annotations

import gc
import json
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import rows_of, table
from roadloom.llm.tokens import VOCABULARY, chunk_words, pieces_of, special_tokens, text_chunks, word_ids, words_of

BLOCK_BYTES, BUNDLE_BYTES, BUNDLE_ROWS = 3 << 20, 256 << 10, 512
#: Buckets of words: one for every ``BLOCKS_A_BUCKET`` blocks, so that a block's lists stay few and long.
LEAST_BUCKETS, MOST_BUCKETS, BLOCKS_A_BUCKET = 64, 1024, 16
#: Words after which a task starts its table of them anew.
_WORDS = 500_000
#: Ids that are decoded in one join.
_TOKENS = 1 << 18


def _bundles(docs: DataFrame, blocks: int) -> DataFrame:
    """``(block, bundle)``: runs of documents, compressed together for the shuffle and dealt evenly to blocks.

    A run's block follows from its task and number, so equal runs go to different blocks.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for ids, texts in rows_of(batches, "doc_id", "text", size=BUNDLE_ROWS):
            block, bundle, at, size = [], [], 0, 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size >= BUNDLE_BYTES or i == len(texts) - 1:
                    run = pa.record_batch([pa.array(ids[at : i + 1], pa.int64()), pa.array(texts[at : i + 1], pa.large_string())], ["doc_id", "text"])
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, run.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
                        w.write_batch(run)
                    bundle.append(out.getvalue().to_pybytes())
                    block.append(xxhash.xxh64_intdigest(f"{task}:{number}") % blocks)
                    at, size, number = i + 1, 0, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bundle, pa.binary())], ["block", "bundle"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(pack, "block long, bundle binary")


def _documents(bundles: pa.ChunkedArray) -> Iterator[tuple[int, str]]:
    for x in bundles:
        run = pa.ipc.open_stream(x.as_py()).read_all()
        for doc_id, text in zip(run.column("doc_id").to_pylist(), run.column("text").to_pylist(), strict=True):
            yield doc_id, text or ""


def _chunks(bundles: pa.ChunkedArray, path: str, docs: list[tuple[int, list[str]]] | None = None) -> dict[str, list[str]]:
    """The words of each different chunk of a block; ``docs`` gets each document's chunks in order."""
    known: dict[str, list[str]] = {}
    special = special_tokens(path)
    for doc_id, text in _documents(bundles):
        chunks = text_chunks(text, path)
        if docs is not None:
            docs.append((doc_id, chunks))
        fresh = set(chunks).difference(known)
        if special is not None and special.search(text):
            known.update((chunk, chunk_words(chunk, path)) for chunk in fresh)
        else:
            known.update(zip(fresh, map(words_of, fresh), strict=True))
    return known


def _by_bucket(known: dict[str, list[str]], buckets: int) -> dict[int, list[str]]:
    """A block's distinct words, in order, for each bucket that has any."""
    words: set[str] = set()
    for own in known.values():
        words.update(own)
    lists = defaultdict(list)
    for word in sorted(words):
        lists[crc32(word.encode()) % buckets].append(word)
    return lists


def _uncollected(f: Callable[..., pa.Table], *args: pa.Table) -> pa.Table:
    """``f(*args)`` without searches for cycles: a block's lists of words are many, hold no cycles and go with their last reference."""
    on = gc.isenabled()
    gc.disable()
    try:
        return f(*args)
    finally:
        if on:
            gc.enable()


def encode(docs: DataFrame, path: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_tokens, ids)``; ``ids`` holds little-endian unsigned 32-bit integers.

    Documents go to blocks of about ``block_bytes`` of text. Each block gives its
    distinct words, in a compressed list for each bucket of words; the lists of a bucket
    meet in one place, where each distinct word is encoded once (again only after
    ``_WORDS`` others); the ids go back to the blocks that asked, in the lists' order, and
    each document's words are replaced by ids in order of position. Texts cross one
    shuffle, words one and ids one; a frequent word is there once a block, however
    often it occurs, and a block's lists are at most ``MOST_BUCKETS``.

    Null texts count as empty: no ids. Repeated rows and ids are kept; a text may
    be of any length; other columns play no part; an empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + size // block_bytes
    blocks, buckets = _bundles(docs, n_blocks), min(MOST_BUCKETS, LEAST_BUCKETS + n_blocks // BLOCKS_A_BUCKET)
    # ids of a small vocabulary travel in two bytes
    narrow = np.dtype("<u2" if len(pieces_of(path)) <= 1 << 16 else "<u4")

    def asked_of(group: pa.Table) -> pa.Table:
        lists = _by_bucket(_chunks(group.column("bundle"), path), buckets)
        squeeze = zstandard.ZstdCompressor(6).compress
        packed = [squeeze(json.dumps(x, ensure_ascii=False).encode()) for x in lists.values()]
        block = pa.array(np.full(len(packed), group.column("block")[0].as_py(), dtype=np.int64))
        return pa.table({"block": block, "bucket": pa.array(list(lists), pa.int64()), "words": pa.array(packed, pa.binary())})

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, grow = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
        last, known = None, {}
        for block, bucket, lists in rows_of(batches, "block", "bucket", "words", size=64):
            lengths, ids = [], []
            for own, packed in zip(bucket, lists, strict=True):
                if own != last or len(known) >= _WORDS:
                    last, known = own, {}
                asked = json.loads(grow(packed))
                for word in asked:
                    if word not in known:
                        known[word] = array(narrow.char, word_ids(word, path)).tobytes()
                lengths.append(squeeze(np.array([len(known[w]) for w in asked], dtype="<u4").tobytes()))
                ids.append(squeeze(b"".join([known[w] for w in asked])))
            arrays = [pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), *(pa.array(x, pa.binary()) for x in (lengths, ids))]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "bucket", "lengths", "ids"])

    def ids_of(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grow, ids = zstandard.ZstdDecompressor().decompress, {}
        docs: list[tuple[int, list[str]]] = []
        known = _chunks(texts.column("bundle"), path, docs)
        lists = _by_bucket(known, buckets)
        for bucket, lengths, joint in zip(*(answers.column(c) for c in ("bucket", "lengths", "ids")), strict=True):
            ends = np.cumsum(np.frombuffer(grow(lengths.as_py()), dtype="<u4").astype(np.int64)).tolist()
            joint = grow(joint.as_py())
            for word, start, end in zip(lists.pop(bucket.as_py()), [0, *ends[:-1]], ends, strict=True):
                ids[word] = joint[start:end]
        own = {chunk: ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words]) for chunk, words in known.items()}
        known.clear()
        ids.clear()
        doc_ids, out = [d for d, _ in docs], []
        for _, chunks in docs:
            joint = b"".join(map(own.__getitem__, chunks))
            out.append(np.frombuffer(joint, narrow).astype("<u4").tobytes())
            chunks.clear()
        counts = pa.array([len(x) // 4 for x in out], pa.int64())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": counts, "ids": pa.array(out, pa.binary())})

    def words(group: pa.Table) -> pa.Table:
        return _uncollected(asked_of, group)

    def joined(texts: pa.Table, answers: pa.Table) -> pa.Table:
        return _uncollected(ids_of, texts, answers)

    asked = blocks.groupBy("block").applyInArrow(words, "block long, bucket long, words binary")
    asked = asked.repartition("bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(encoded, "block long, bucket long, lengths binary, ids binary")
    both = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(joined, "doc_id long, n_tokens long, ids binary")


@cache
def piece_table(path: str) -> pa.Table:
    """``(id, piece)`` of the vocabulary."""
    pieces = pieces_of(path)
    return pa.table({"id": pa.array(np.arange(len(pieces), dtype=np.uint32)), "piece": pa.array(pieces, pa.binary())})


def _texts(ids: list[np.ndarray], path: str) -> list[str]:
    """Texts of a few documents' ids: their distinct ids are joined to ``(id, piece)``, and pieces joined back by position."""
    if not ids:
        return []
    numbers = pa.array(np.concatenate(ids)).dictionary_encode()
    asked = pa.table({"at": pa.array(np.arange(len(numbers.dictionary))), "id": numbers.dictionary})
    found = asked.join(piece_table(path), "id", join_type="left outer", use_threads=False).sort_by("at")
    pieces = pc.fill_null(found.column("piece").combine_chunks(), b"")
    ends = np.cumsum([len(x) for x in ids]).tolist()
    return [_joint(pieces.take(numbers.indices.slice(start, end - start))) for start, end in zip([0, *ends[:-1]], ends, strict=True)]


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``; added tokens are spelt out.

    About ``_TOKENS`` ids at a time, each distinct one is joined to the id-to-piece table and its piece joined back by position; that table is as long as the vocabulary,
    so every worker holds it and the join needs no shuffle. Ids without a piece give nothing; bytes that
    aren't UTF-8 give U+FFFD; null ids give null. An input column named ``decoded`` is replaced.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts: list[str | None] = [None] * part.num_rows
                waiting: dict[int, np.ndarray] = {}
                for i, ids in enumerate(part.column("ids")):
                    if ids.is_valid:
                        waiting[i] = np.frombuffer(ids.as_buffer(), "<u4")
                    if waiting and (i == part.num_rows - 1 or sum(map(len, waiting.values())) >= _TOKENS):
                        for k, text in zip(waiting, _texts(list(waiting.values()), path), strict=True):
                            texts[k] = text
                        waiting = {}
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])
    return kept.mapInArrow(run, schema)


def _joint(found: pa.Array) -> str:
    """The pieces one after the other: an Arrow column's values lie so already."""
    _, offsets, values = found.buffers()
    ends = np.frombuffer(offsets, "<i4", count=len(found) + 1, offset=4 * found.offset)
    return values.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().decode("utf-8", "replace") if values else ""


def op4_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
