"""Vector codes: a codebook for each part of the vectors, trained by Yinyang Lloyd rounds over integers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import by_length, list_matrix, sound_vectors, table, written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries of a codebook that share a lower bound, on average.
ENTRIES_A_GROUP = 10
#: Largest component after scaling: sums of squares of up to 60 such differences fit a long.
LARGEST = 1 << 27
#: A label with more than this share of all rows is joined by broadcast: at most as many as its inverse.
HEAVY = 0.001
#: Bounds are stored as whole numbers of this fraction of a unit, rounded down.
_STEP = 16
_ROWS = 4096
_STATE = "vec_id long, label int, v array<int>, code binary, near array<int>, error long, scanned int"


@dataclass(frozen=True)
class Codebooks:
    """For each part its columns, its entries, and the group of each entry."""

    spans: list[tuple[int, int]]
    entries: list[np.ndarray]
    groups: list[np.ndarray]

    def sha256(self) -> str:
        """Of all entries' components by part, entry and position."""
        return sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def grouped(entries: np.ndarray, a_group: int = ENTRIES_A_GROUP) -> np.ndarray:
    """A group for each entry, by a few rounds of k-means over the entries themselves."""
    count = max(1, -(-len(entries) // a_group))
    centres = entries[np.linspace(0, len(entries) - 1, count).astype(int)].astype(np.float64) if len(entries) else np.zeros((1, entries.shape[1]))
    own = np.zeros(len(entries), dtype=np.int64)
    for _ in range(5):
        own = ((entries[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(own):
            centres[g] = entries[own == g].mean(axis=0)
    return np.unique(own, return_inverse=True)[1].reshape(-1)


def assigned(x: np.ndarray, entries: np.ndarray, group: np.ndarray, code: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row of ``x``, its squared distance, new lower bounds, and how many entries were scanned.

    ``code`` is the entry of the round before and ``near`` has for each group a distance that none of its entries but
    that one is nearer than. Only groups whose bound isn't above the distance to ``code`` are
    scanned; distances are whole squares, so of equal ones the lower index is sure to win.
    """
    count = near.shape[1]
    own = ((x - entries[code]) ** 2).sum(axis=1)
    reach = np.sqrt(own.astype(np.float64)) * (1 + 1e-9)
    open_ = near <= reach[:, None]
    first, second = np.full(near.shape, np.inf), np.full(near.shape, np.inf)
    best, best_d = code.copy(), own.copy()
    scanned = np.zeros(len(x), dtype=np.int64)
    for g in range(count):
        rows, members = np.flatnonzero(open_[:, g]), np.flatnonzero(group == g)
        if not len(rows):
            continue
        d = ((x[rows, None, :] - entries[members][None]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        least = d[np.arange(len(rows)), at]
        first[rows, g] = np.sqrt(least.astype(np.float64))
        if len(members) > 1:
            second[rows, g] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
        entry = members[at]
        wins = (least < best_d[rows]) | ((least == best_d[rows]) & (entry < best[rows]))
        best[rows[wins]], best_d[rows[wins]] = entry[wins], least[wins]
        scanned[rows] += len(members)
    lower = np.where(open_, first, near)
    # in the new entry's group the bound is of the others; the old entry counts in its own again
    at, every = group[best], np.arange(len(x))
    fresh = open_[every, at]
    lower[every[fresh], at[fresh]] = second[every[fresh], at[fresh]]
    left = (best != code) & ~open_[every, group[code]]
    lower[every[left], group[code[left]]] = np.minimum(lower[every[left], group[code[left]]], np.sqrt(own[left].astype(np.float64)))
    return best, best_d, lower, scanned


def _drift(old: np.ndarray, new: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The farthest move of an entry in each group."""
    moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))
    return np.array([moved[group == g].max() for g in range(group.max(initial=-1) + 1)])


def _round(rows: DataFrame, width: int, before: Codebooks | None, books: Codebooks) -> DataFrame:
    """Rows of ``_STATE`` with every part's entry in ``books``; ``before`` are the codebooks that their bounds are of."""
    drifts = [_drift(o, n, g) for o, n, g in zip(before.entries, books.entries, books.groups, strict=True)] if before else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                v = list_matrix(part.column("v"), width, np.int64)
                if np.abs(v).max(initial=0) > LARGEST:
                    raise ValueError(f"components beyond {LARGEST} after scaling")
                n, error, scanned, codes, bounds = len(v), np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), [], []
                old = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(n, -1) if before else None
                near = list_matrix(part.column("near"), sum(len(d) for d in drifts), np.float64) / _STEP if before else None
                seen = 0
                for p, ((a, b), entries, group) in enumerate(zip(books.spans, books.entries, books.groups, strict=True)):
                    count = group.max() + 1
                    if before:
                        code, lower = old[:, p].astype(np.int64), near[:, seen : seen + count] - drifts[p] * (1 + 1e-9)
                        seen += count
                    else:
                        code, lower = np.zeros(n, np.int64), np.full((n, count), -1.0)
                    best, d, lower, looked = assigned(v[:, a:b], entries, group, code, lower)
                    error, scanned = error + d, scanned + looked
                    codes.append(best.astype(np.uint8))
                    bounds.append(np.floor(np.clip(lower, -1.0, 1e8) * (1 - 1e-9) * _STEP).astype(np.int32))
                flat = np.concatenate(bounds, axis=1)
                held = np.stack(codes, axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), pa.array(flat.ravel()))
                columns = [part.column("vec_id"), part.column("label"), part.column("v"), pa.array([r.tobytes() for r in held], pa.binary()), lists, pa.array(error), pa.array(scanned.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _STATE.split(", ")])

    return rows.mapInArrow(run, _STATE)


def _moved(state: DataFrame, width: int, books: Codebooks) -> Codebooks:
    """Every entry at the floor of its parts' mean; entries without parts stay. Tasks add up first, so few rows are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        for batch in batches:
            if not batch.num_rows:
                continue
            v = list_matrix(batch.column("v"), width, np.int64)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(v), -1)
            for p, (a, b) in enumerate(books.spans):
                counts[p] += np.bincount(codes[:, p], minlength=len(counts[p]))
                np.add.at(sums[p], codes[:, p], v[:, a:b])
        rows = [(p, k, j, int(counts[p][k]), int(s)) for p, own in enumerate(sums) for k in np.flatnonzero(counts[p]) for j, s in enumerate(own[k])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["part", "entry", "at", "n", "total"])

    added = state.select("v", "code").mapInArrow(run, "part long, entry long, at long, n long, total long")
    added = added.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    entries = [e.copy() for e in books.entries]
    # a row for each component of the codebooks
    for r in added.collect():
        entries[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
    return Codebooks(books.spans, entries, books.groups)


def coded(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """Rows of ``_STATE`` of ``vectors(vec_id, embedding, label)``, all of length ``width``, and the final codebooks.

    A component x is ``floor(scale * x)``, x as double. Vectors are cut into ``parts`` equal consecutive parts (lengths that
    don't divide are cut at the floors), and each part position has up to 256 entries, at first the parts of the rows with the smallest ids (null
    ids last; of equal ids the smaller vector first). Each round assigns all parts, then moves the entries; at the end parts are assigned
    once more. A round reads and writes each row once, with its bounds in the shared folder: a lost executor costs a part of a round.
    What is sent to tasks are codebooks. Repeated rows count as often as they occur; components beyond ``LARGEST`` raise.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    v = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v)
    start = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    first = np.array([r.v for r in start], dtype=np.int64).reshape(len(start), width)
    spans = [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
    own = [first[:, a:b] for a, b in spans]
    books = Codebooks(spans, own, [grouped(e) for e in own])
    if not len(start):
        return written(rows.where("FALSE").mapInArrow(lambda batches: batches, _STATE), "codes"), books
    state, before = written(_round(rows, width, None, books), "codes"), books
    for _ in range(rounds):
        books = _moved(state, width, before)
        state, before = written(_round(state, width, before, books), "codes"), books
    return state, books


def with_label_error(rows: DataFrame, heavy: float = HEAVY) -> DataFrame:
    """``rows(label, error, ...)`` with ``label_error``, the sum of ``error`` over equal labels, nulls together.

    Sums are made before the shuffle. Labels of more than a share ``heavy`` of the rows, of which there are few, are
    joined by broadcast, and the others' rows in a shuffle, so no task gets a large label's rows.
    """
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    total = rows.count()
    sums = written(sums, "labels")
    large = F.broadcast(sums.where(F.col("n") > total * heavy).select(F.col("label").alias("_label"), F.col("label_error").alias("_large")))
    met = rows.join(large, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    small = sums.where(F.col("n") <= total * heavy).select(F.col("label").alias("_label"), "label_error")
    rest = met.where("_large IS NULL").drop("_large").join(small, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return met.where("_large IS NOT NULL").withColumnRenamed("_large", "label_error").unionByName(rest)


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every sound vector, and its label's error; vectors of each length have codebooks of their own."""

    def run(vectors: DataFrame, width: int) -> DataFrame:
        state, books = coded(vectors, width)
        return state.withColumn("codebooks_sha256", F.lit(books.sha256()))

    codes = by_length(sound_vectors(table(spark, sf_dir, "embeddings")), run)
    return with_label_error(codes.drop("v", "near", "scanned")).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256"
    )


def _assign_sql(into: str, books: str) -> str:
    return f"""{into} AS MATERIALIZED (
  SELECT r, p.w, p.p, min(CAST(list_inner_product(p.x, p.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(p.x, c.x) AS HUGEINT) * 256 + c.k) AS best
  FROM p JOIN {books} c ON p.w = c.w AND p.p = c.p GROUP BY ALL
)"""


def _move_sql(into: str, own: str, books: str) -> str:
    return f"""{into}_sums AS (
  SELECT w, p, k, i, sum(x[i]) AS s, count(*) AS n FROM (
    SELECT p.w, p.p, {own}.best % 256 AS k, p.x, unnest(range(1, len(p.x) + 1)) AS i FROM p JOIN {own} USING (r, w, p)
  ) GROUP BY ALL
), {into} AS MATERIALIZED (
  SELECT c.w, c.p, c.k, coalesce(m.x, c.x) AS x FROM {books} c LEFT JOIN (
    SELECT w, p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM {into}_sums GROUP BY ALL
  ) m ON c.w = m.w AND c.p = m.p AND c.k = m.k
)"""


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY len(v) ORDER BY vec_id NULLS LAST, v) - 1 AS r, len(v) AS w FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  )
), p AS MATERIALIZED (
  SELECT r, w, p, v[p * w // {PARTS} + 1 : (p + 1) * w // {PARTS}] AS x FROM v, range({PARTS}) t(p)
), b0 AS MATERIALIZED (
  SELECT w, p, r AS k, x FROM p WHERE r < {ENTRIES}
), {_assign_sql('a1', 'b0')}, {_move_sql('b1', 'a1', 'b0')}, {_assign_sql('a2', 'b1')}, {_move_sql('b2', 'a2', 'b1')}, {_assign_sql('a3', 'b2')},
h AS (SELECT w, sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2 GROUP BY w),
e AS (SELECT r, w, string_agg(printf('%02x', CAST(best % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a3 GROUP BY r, w)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN e USING (r, w) JOIN h USING (w)
"""
