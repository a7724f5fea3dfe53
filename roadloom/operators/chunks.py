"""Ordered folds over keys of any length: a key's rows run in many tasks, each from the state that the rows before leave.

Rows in order of key and time are cut into chunks of about equal size. A chunk that goes on with the key of the one
before starts from a guess, all of them at once. Where the state that reaches a chunk isn't what it was
folded from, it is folded again; a part of the state that a chunk didn't change is taken to pass through it, so states that
seldom change cross many chunks in one round. Guesses only decide the number of rounds, never the result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.session import cut

CHUNK = "_chunk"


class Fold(Protocol):
    """A fold over one key's rows in order; ``state`` gives its parts, from which another one goes on."""

    def take(self, rows: list[tuple]) -> list[tuple]: ...

    def end(self) -> list[tuple]: ...

    def state(self) -> tuple: ...


#: A fold from a state, or from a key's beginning.
Maker = Callable[[tuple | None], Fold]
#: A guess of the state at a chunk's start, from the key's first row and the last row before the chunk.
Guess = Callable[[tuple, tuple], tuple | None]


def ordered_chunks(rows: DataFrame, key: str, *order: str, chunks: int | None = None) -> DataFrame:
    """``rows`` in order of ``key`` and ``order``, cut into ranges, with the range's number in ``_chunk``.

    The columns together should differ in every row, so that any key can be cut. Without ``chunks`` there are as
    many as Spark makes of the rows' size. The chunks are written to the shared folder, so that they stay as they are.
    """
    by = [key, *order]
    ranged = rows.repartitionByRange(chunks, *by) if chunks else rows.repartitionByRange(*by)
    return cut(ranged.sortWithinPartitions(*by).withColumn(CHUNK, F.spark_partition_id()))


def _packed(state: tuple | None) -> tuple[bytes, ...] | None:
    return None if state is None else tuple(pickle.dumps(part) for part in state)


def _unpacked(state: tuple[bytes, ...] | None) -> tuple | None:
    return None if state is None else tuple(pickle.loads(part) for part in state)  # noqa: S301


def fold_chunks(chunks: DataFrame, key: str, order: list[str], make: Maker, schema: T.StructType, hint: list[str], guess: Guess) -> DataFrame:
    """What ``make``'s folds give for the rows of ``ordered_chunks``, key by key, as rows of ``schema``.

    ``guess`` gets the columns ``hint`` of two rows. Of a chunk the driver gets its first row, its last row and its last key's
    state, nothing else. Columns of ``schema`` that the rows have keep their type.
    """
    names = [c for c in chunks.columns if c != CHUNK]
    row = F.struct(*(F.col(c) for c in [key, *order]), F.struct(F.lit(0).alias("_"), *hint).alias("row"))
    ends = sorted(chunks.groupBy(CHUNK).agg(F.min(row).alias("a"), F.max(row).alias("z")).collect(), key=lambda r: r[CHUNK])
    before = {b[CHUNK]: a[CHUNK] for a, b in zip(ends, ends[1:], strict=False) if a["z"][key] == b["a"][key]}
    goes_on = set(before.values())
    #: chunks of a single key: the state they leave depends on the one they get
    whole = {r[CHUNK] for r in ends if r["a"][key] == r["z"][key]}
    last_key = {r[CHUNK]: r["z"][key] for r in ends}
    enters: dict[int, tuple[bytes, ...] | None] = {}
    first = prior = None
    for r in ends:
        if r[CHUNK] in before:
            enters[r[CHUNK]] = _packed(guess(first, prior))
        if r[CHUNK] not in before or r[CHUNK] not in whole:
            first = tuple(r["a" if r[CHUNK] in whole else "z"]["row"][1:])
        prior = tuple(r["z"]["row"][1:])

    got = lambda of, c: of.get(c) if c in whole else None
    exits: dict[int, tuple[bytes, ...]] = {}
    ran: dict[int, tuple[bytes, ...] | None] = {}
    todo = set(goes_on)
    while todo:
        exits.update(_exits(chunks, key, names, make, {c: (last_key[c], got(enters, c)) for c in todo}))
        ran.update({c: enters.get(c) for c in todo})
        todo = set()
        for c in sorted(before):
            left, came, was = exits[before[c]], got(enters, before[c]), got(ran, before[c])
            through = [came is not None and was is not None and part == was[i] for i, part in enumerate(left)]
            reaches = tuple(came[i] if through[i] else part for i, part in enumerate(left))
            if reaches != enters[c]:
                enters[c] = reaches
                if c in goes_on and c in whole:
                    todo.add(c)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, own, chunk, types = None, None, None, []
        for batch in batches:
            out: list[tuple] = []
            for here, rows in _runs(batch, key, names):
                if fold is None:
                    chunk = batch.column(CHUNK)[0].as_py()
                    fold, own = make(_unpacked(enters.get(chunk))), here
                elif here != own:
                    out += fold.end()
                    fold, own = make(None), here
                out += fold.take(rows)
            types = [batch.schema.field(f.name).type if f.name in names else _ARROW[f.dataType.typeName()] for f in schema.fields]
            yield _batch(out, types, schema.names)
        if fold is not None and chunk not in goes_on:
            yield _batch(fold.end(), types, schema.names)

    return chunks.mapInArrow(run, schema)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_ARROW = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _runs(batch: pa.RecordBatch, key: str, names: list[str]) -> Iterator[tuple[object, list[tuple]]]:
    """Stretches of rows with the same key."""
    keys = batch.column(key).to_pylist()
    rows = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
    at = 0
    while at < len(keys):
        end = at + 1
        while end < len(keys) and keys[end] == keys[at]:
            end += 1
        yield keys[at], rows[at:end]
        at = end


def _exits(chunks: DataFrame, key: str, names: list[str], make: Maker, wanted: dict[int, tuple]) -> dict[int, tuple[bytes, ...]]:
    """States in which the last keys of the ``wanted`` chunks leave them; other chunks aren't read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, chunk = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = batch.column(CHUNK)[0].as_py()
            if chunk not in wanted:
                return
            own, state = wanted[chunk]
            fold = fold or make(_unpacked(state))
            for _, rows in _runs(batch.filter(pc.equal(batch.column(key), pa.scalar(own, batch.schema.field(key).type))), key, names):
                fold.take(rows)
        if fold is not None:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([pickle.dumps(_packed(fold.state()))], pa.binary())], ["chunk", "state"])

    return {r["chunk"]: pickle.loads(r["state"]) for r in chunks.mapInArrow(run, "chunk int, state binary").collect()}  # noqa: S301
