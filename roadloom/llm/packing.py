"""Vector bin packing of tokenized examples under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import rows_of, table
from roadloom.llm.tokens import VOCABULARY, text_ids

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 16, 2048
END = np.array([1], dtype="<u4").tobytes()
EXAMPLES_A_BUCKET = 512
_PIECE = "doc_id long, start long, length long, loss long, doc_tokens long, ids binary"


def tokenized_pieces(docs: DataFrame, path: str = VOCABULARY, max_tokens: int = MAX_TOKENS, prompt: str | None = None) -> DataFrame:
    """Every document's ids and a closing id 1, cut into pieces of ``max_tokens`` ids and a rest.

    With ``prompt``, the column of that name holds a text that comes first, and whose ids bear no
    loss: instruction data. All other ids bear loss but a document's first, which nothing precedes. Null and
    empty texts without a prompt give one piece that holds the closing id alone.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts, prompts in rows_of(batches, "doc_id", "text", "prompt", size=256):
            rows = []
            for doc_id, text, before in zip(doc_ids, texts, prompts, strict=True):
                asked = text_ids(before, path).tobytes()
                ids = asked + text_ids(text, path).tobytes() + END
                total, free = len(ids) // 4, max(1, len(asked) // 4)
                for start in range(0, total, max_tokens):
                    part = ids[4 * start : 4 * (start + max_tokens)]
                    n = len(part) // 4
                    rows.append((doc_id, start, n, n - min(n, max(0, free - start)), total, part))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64()] * 5 + [pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "loss", "doc_tokens", "ids"])

    first = F.col(prompt) if prompt else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", first.alias("prompt")).mapInArrow(run, _PIECE)


def pack_vectors(sizes: np.ndarray, limits: np.ndarray, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Bins of ``(item, start, length)``; ``sizes`` has a row (tokens, segments, loss) for each item.

    Bin-centric greedy: the open bin takes, of the items that fit all its limits,
    the one with the largest dot product of its size and what is left of the bin,
    both as shares of the limits (ties: the first item). When none fits, the bin is
    closed; with ``cut``, the largest item first gives up as many tokens as fit. An
    item that no empty bin holds raises.
    """
    size, start = sizes.astype(np.int64).copy(), np.zeros(len(sizes), dtype=np.int64)
    alive = np.arange(len(sizes))
    bins: list[list[tuple[int, int, int]]] = []
    while len(alive):
        left, held, taken = limits.astype(np.int64).copy(), [], []
        tokens, segments, loss = (np.ascontiguousarray(c) for c in size[alive].T)
        shares = size[alive] / limits.astype(np.float64) ** 2
        while True:
            fits = (tokens <= left[0]) & (segments <= left[1]) & (loss <= left[2])
            fits[taken] = False
            score = shares @ left
            score[~fits] = -1.0
            k = int(score.argmax())
            if score[k] < 0:
                break
            item = int(alive[k])
            held.append((item, int(start[item]), int(tokens[k])))
            left -= size[item]
            taken.append(k)
        alive = np.delete(alive, taken)
        if cut and len(alive) and left.min() > 0:
            item = int(alive[size[alive, 0].argmax()])
            n = int(min(left[0], left[2], size[item, 0] - 1))
            if n > 0:
                held.append((item, int(start[item]), n))
                # ids that bear no loss stand first in a document, so they leave with the part cut off
                free = int(size[item, 0] - size[item, 2])
                start[item] += n
                size[item] -= (n, 0, max(0, n - free))
        if not held:
            raise ValueError("an example is larger than the limits")
        bins.append(held)
    return bins


def packed(
    pieces: DataFrame,
    buckets: int,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
    cut: bool = True,
) -> DataFrame:
    """Packs ``pieces`` into sequences; returns them with ``sequence_id`` and ``offset``.

    Pieces are dealt to ``buckets`` by a hash of their content and of the task that made them,
    so that repeated rows spread too, and each bucket is packed by itself, so at most
    one sequence a bucket stays open. Without ``cut`` pieces stay whole, as instruction
    data wants. Repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    limits = np.array([max_tokens, max_segments, max_loss])

    def run(group: pa.Table) -> pa.Table:
        order = sorted(zip(*(group.column(n).to_pylist() for n in ("doc_id", "start", "length", "ids", "doc_tokens", "loss", "bucket")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, *r[1:4]))
        sizes = np.array([(r[2], 1, r[5]) for r in order])
        full = (sizes[:, 0] == max_tokens) & (sizes[:, 2] <= max_loss)
        rest = np.flatnonzero(~full)
        bins = [[(int(i), 0, max_tokens)] for i in np.flatnonzero(full)]
        bins += [[(int(rest[i]), s, n) for i, s, n in held] for held in pack_vectors(sizes[rest], limits, cut)]
        rows = []
        for at, held in enumerate(bins):
            offset = 0
            for item, start, n in held:
                doc_id, first, _, ids, total, _, bucket = order[item]
                rows.append((doc_id, first + start, n, total, (bucket << 32) | at, offset, ids[4 * start : 4 * (start + n)]))
                offset += n
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        types = [pa.int64()] * 6 + [pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    bucket = F.pmod(F.xxhash64(F.lit(8), "doc_id", "start", F.crc32("ids"), F.spark_partition_id()), F.lit(buckets))
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return pieces.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str = VOCABULARY, examples: int = EXAMPLES_A_BUCKET) -> DataFrame:
    """All of ``docs(doc_id, text)`` in sequences; other columns play no part."""
    return packed(tokenized_pieces(docs, path), 1 + docs.count() // examples)


def _digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a sequence."""
    return _digest(pack_documents(table(spark, sf_dir, "documents")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, in sequences of at most 2048 tokens: a row for each piece."""
    return _digest(pack_documents(docs))
