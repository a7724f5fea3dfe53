"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a local session gets a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not root and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-"))
    return (root or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in files that every executor can read."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, whose size Spark then knows when it plans joins."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 0 by 5; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_share(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that ``key`` and ``seed`` decide."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def rows_of(batches: Iterable[pa.RecordBatch], *names: str, size: int = 512) -> Iterator[list[list]]:
    """Lists of the named columns' values, of at most ``size`` rows each."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield [part.column(n).to_pylist() for n in names]


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose ``embedding`` isn't null and holds neither nulls nor components that aren't finite."""
    return vectors.where(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def by_length(vectors: DataFrame, run: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``run(rows, length)`` for the vectors of each length, as one table; of a table without rows the result for length 0.

    Tables hold vectors of few lengths, usually of one.
    """
    lengths = sorted(r[0] for r in vectors.select(F.size("embedding")).distinct().collect()) or [0]
    parts = [run(vectors.where(F.size("embedding") == n), n) for n in lengths]
    return reduce(DataFrame.unionByName, parts)


def list_matrix(column: pa.ListArray, width: int, dtype: type) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)
