"""Whitening of embeddings: principal components by a randomised range finder over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import by_length, list_matrix, sound_vectors, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS, OVERSAMPLE, PASSES, SEED = 32, 16, 4, 13
#: Largest residual of a component, as a share of the largest eigenvalue, that needs no wider range.
TOLERANCE = 1e-13
_ROWS = 4096
_ROW = "vec_id long, component int, n long, deviation long, whitened double"


@dataclass(frozen=True)
class Whitening:
    """Count and sums of the fit list, components as columns, their eigenvalues, the trace, and whether the range was widened."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    widened: bool

    def scaled(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; those without variance are zero."""
        sound = self.eigenvalues > 16 * len(self.sums) * np.finfo(float).eps * self.eigenvalues.max(initial=0)
        return self.components * np.where(sound, 1 / np.sqrt(np.where(sound, self.eigenvalues, 1.0)), 0.0)


def integer_entries(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(vec_id, x)`` with ``x`` the longs ``floor(scale * c) + offset`` of each entry c, as double."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale) + offset)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _added(rows: DataFrame, width: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows of the matrix ``of(x)``: tasks add up their rows, Spark adds up the tasks' matrices by row and column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.int64 if kind == "long" else np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                total += of(list_matrix(batch.column("x").slice(at, _ROWS), width, np.int64))
        at = [pa.array(i.ravel().astype(np.int32)) for i in np.indices(shape)]
        yield pa.RecordBatch.from_arrays([*at, pa.array(total.ravel())], ["i", "j", "total"])

    sums = rows.select("x").mapInArrow(run, f"i int, j int, total {kind}").groupBy("i", "j").agg(F.sum("total").alias("total"))
    out = np.zeros(shape, dtype=np.int64 if kind == "long" else np.float64)
    for r in sums.collect():
        out[r["i"], r["j"]] = r["total"]
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n``: the difference is a whole number of n-ths, and rounded once."""
    return (n * x - sums) / n


def fit_whitening(rows: DataFrame, width: int, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = SEED) -> Whitening:
    """Fits all ``rows(x)``, whose covariance is never made: every pass multiplies it by a few columns.

    Range finder: ``components + oversample`` random columns go through the centred rows ``passes`` times, and are made orthonormal after
    each. The last pass also gives their Rayleigh quotient, whose eigenvectors (Rayleigh-Ritz) give the components, and their
    residuals. Where a residual is above ``tolerance`` times the largest eigenvalue, the columns are completed to a basis of the whole
    space, and one more pass gives all components to double precision. At the driver there are matrices of ``width`` rows and at most ``width`` columns.
    """
    k = min(components, width)
    size = _added(rows, width, (1, width + 1), lambda x: np.append(x.sum(axis=0), len(x))[None], "long")[0]
    n, sums = int(size[-1]), size[:-1]
    if not n or not width:
        return Whitening(n, sums, np.zeros((width, k)), np.zeros(k), 0.0, False)

    def through(q: np.ndarray) -> tuple[np.ndarray, float]:
        def of(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            squares = np.zeros((width, 1))
            squares[0] = (c * c).sum()
            return np.concatenate([c.T @ (c @ q), squares], axis=1)

        out = _added(rows, width, (width, q.shape[1] + 1), of, "double") / n
        return out[:, :-1], float(out[0, -1])

    def ritz(q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        quotient = q.T @ z
        values, w = np.linalg.eigh((quotient + quotient.T) / 2)
        values, w = values[::-1][:k], w[:, ::-1][:, :k]
        return q @ w, np.maximum(values, 0.0), float(np.sqrt(((z @ w - q @ w * values) ** 2).sum(axis=0)).max())

    random = np.random.Generator(np.random.PCG64(seed))
    q = np.linalg.qr(random.standard_normal((width, min(width, components + oversample))))[0]
    for at in range(passes if q.shape[1] < width else 1):
        if at:
            q = np.linalg.qr(z)[0]
        z, trace = through(q)
    found, values, residual = ritz(q, z)
    widened = residual > tolerance * values[0] and q.shape[1] < width
    if widened:
        q = np.linalg.qr(np.concatenate([q, random.standard_normal((width, width - q.shape[1]))], axis=1))[0]
        z, trace = through(q)
        found, values, _ = ritz(q, z)
    return Whitening(n, sums, found, values, trace, bool(widened))


def whitened(rows: DataFrame, width: int, fit: Whitening) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened)``: a row for each of ``rows(vec_id, x)`` and component, from 1.

    ``deviation`` is the whole sum over dimensions of ``(n * x - sums)²``, null where a long doesn't hold it. A component without
    variance has 0. Rows don't meet.
    """
    scaled, k = fit.scaled(), len(fit.eigenvalues)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = list_matrix(part.column("x"), width, np.int64)
                y = _centred(x, fit.n, fit.sums) @ scaled
                far = fit.n * x - fit.sums
                if (far.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
                    deviation = pa.array((far * far).sum(axis=1))
                else:
                    exact = [sum(d * d for d in r) for r in far.tolist()]
                    deviation = pa.array([d if d < 2**63 else None for d in exact], pa.int64())
                each = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, fit.n)), deviation.take(each), pa.array(y.ravel())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ROW.split(", ")])

    return rows.mapInArrow(run, _ROW)


def identity_error(rows: DataFrame, width: int, fit: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over the components with variance.

    The covariance is of the whitened rows themselves, in a pass of their own; their means, zero but for rounding, are taken off.
    """
    scaled = fit.scaled()
    scaled = scaled[:, (scaled != 0).any(axis=0)]
    k = scaled.shape[1]
    if not k:
        return 0.0

    def of(x: np.ndarray) -> np.ndarray:
        y = _centred(x, fit.n, fit.sums) @ scaled
        return np.concatenate([y.T @ y, y.sum(axis=0)[None]])

    out = _added(rows, width, (k + 1, k), of, "double") / fit.n
    return float(np.abs(out[:-1] - np.outer(out[-1], out[-1]) - np.eye(k)).max())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every sound vector; vectors of each length are a fit list of their own.

    Null and repeated ids are rows like any other; empty vectors have no components, an empty table gives no rows.
    """

    def run(vectors: DataFrame, width: int) -> DataFrame:
        rows = integer_entries(vectors)
        fit = fit_whitening(rows, width)
        shares = [float(e / fit.trace) if fit.trace else 0.0 for e in fit.eigenvalues]
        explained = F.element_at(F.array(*(F.lit(s) for s in shares)).cast("array<double>"), F.col("component")) if shares else F.lit(0.0)
        error = identity_error(rows, width, fit)
        return whitened(rows, width, fit).withColumn("explained", explained).withColumn("identity_error", F.lit(error))

    return by_length(sound_vectors(table(spark, sf_dir, "embeddings")), run)
