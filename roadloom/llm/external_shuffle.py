"""Shards in random order by a two-pass external shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import new_folder, table

SHARDS, BUCKET_BYTES, SEED = 16, 32 << 20, 2
_POSITION, _BUCKET, _ORDER, _GROUP = "_position", "_bucket", "_order", "_group"
_ROWS = 2048
#: Most partitions of one shuffle; with more buckets rows go to groups of buckets first.
FAN_OUT = 10_000
#: Most buckets whose starts are broadcast instead of joined in a shuffle of all rows.
SMALL = 100_000


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: of all shards the one whose seeded hash with the key is highest.

    A further shard wins only the keys for which its own hash is the highest, so
    rows move into it and nowhere else. Null keys share a shard.
    """
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["s"]


def shuffle_to_shards(
    docs: DataFrame, folder: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, fan_out: int = FAN_OUT
) -> DataFrame:
    """Writes ``docs(doc_id, text, ...)`` to ``folder`` in shuffled shards, and returns them with ``shard`` and ``slot``.

    Pass one scatters the rows: doc_id picks the shard, and a seeded hash of id
    and text one of its buckets, of about ``bucket_bytes`` of text; every bucket is one partition
    of a shuffle. No shuffle has more than ``fan_out`` partitions: where there are more buckets, rows are
    first written to a folder for each group of up to ``fan_out`` buckets, and each group is dealt to its
    buckets by a shuffle of its own, which writes and reads the table once more. The slots are the same
    either way. Pass two shuffles each bucket in memory (Fisher-Yates, seeded by
    the bucket) and writes it as one file of its shard, in the shuffled order. ``slot``
    counts on over a shard's buckets, from 0 and without gaps. Rows start from a fixed order, so
    the same input gives the same shards again, on any cluster and after a lost
    executor. Nulls, empty texts and repeated rows are rows like any other (equal rows share
    a bucket); input columns shard and slot are replaced; an empty table gives no rows.
    """
    docs = docs.drop("shard", "slot", _BUCKET, _POSITION, _ORDER, _GROUP)
    total = docs.agg(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    buckets = 1 + total // (shards * bucket_bytes)
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(buckets))
    placed = docs.withColumn("shard", shard_of(F.col("doc_id"), shards, seed)).withColumn(_BUCKET, bucket)
    placed = placed.withColumn(_ORDER, F.xxhash64(*docs.columns))
    number, names = F.col("shard") * buckets + F.col(_BUCKET), docs.columns
    parts = _spread(placed, number, shards * buckets, fan_out)

    def fisher_yates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = pa.Table.from_batches(held) if held else None
        if rows is None or not rows.num_rows:
            return
        order = pc.sort_indices(rows, [("doc_id", "ascending"), (_ORDER, "ascending")]).to_numpy()
        # permutation() is a Fisher-Yates shuffle
        seeds = [seed, rows.column("shard")[0].as_py(), rows.column(_BUCKET)[0].as_py()]
        order = order[np.random.Generator(np.random.PCG64(seeds)).permutation(len(order))]
        rows = rows.drop_columns([_ORDER])
        for at in range(0, len(order), _ROWS):
            part = rows.take(pa.array(order[at : at + _ROWS])).combine_chunks()
            position = pa.array(np.arange(at, at + part.num_rows, dtype=np.int64))
            yield from part.append_column(_POSITION, position).to_batches()

    schema = T.StructType([*placed.drop(_ORDER).schema.fields, T.StructField(_POSITION, T.LongType())])
    for rows, first, count in parts:
        dealt = rows.repartitionById(count, (number - first).cast("int"))
        shuffled = dealt.mapInArrow(fisher_yates, schema).sortWithinPartitions("shard", _BUCKET, _POSITION)
        shuffled.write.mode("append" if first else "errorifexists").partitionBy("shard", _BUCKET).parquet(folder)
    written = docs.sparkSession.read.schema(schema).parquet(folder)
    # a row for each bucket, counted from the files' own numbers of rows
    sizes = written.groupBy("shard", _BUCKET).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", _BUCKET, F.coalesce(before, F.lit(0)).alias("_start"))
    slot = (F.col("_start") + F.col(_POSITION)).alias("slot")
    if shards * buckets <= SMALL:
        starts = F.broadcast(starts)
    return written.join(starts, ["shard", _BUCKET]).select(*names, "shard", slot)


def _spread(rows: DataFrame, number: Column, buckets: int, fan_out: int) -> list[tuple[DataFrame, int, int]]:
    """``(rows, first, count)``: the rows of buckets from ``first`` on, ``count`` of them, at most ``fan_out``.

    One group is the rows as they are. Otherwise a shuffle scatters the rows to all groups, several
    partitions for each, at most ``fan_out`` in all, and every group is written to a folder of its own.
    """
    groups = -(-buckets // fan_out)
    if groups == 1:
        return [(rows, 0, buckets)]
    if groups > fan_out:
        raise ValueError("more than fan_out squared buckets; take larger buckets")
    size = -(-buckets // groups)
    ways = max(1, min(fan_out // groups, size))
    group = F.floor(number / size).cast("int")
    target = group * ways + F.pmod(F.xxhash64(F.lit(7), _ORDER), F.lit(ways))
    folder = new_folder(rows.sparkSession, "groups")
    grouped = rows.withColumn(_GROUP, group).repartitionById(groups * ways, target.cast("int"))
    grouped.write.partitionBy(_GROUP).parquet(folder)
    stored = rows.sparkSession.read.schema(grouped.schema).parquet(folder)
    firsts = range(0, buckets, size)
    return [(stored.where(F.col(_GROUP) == i).drop(_GROUP), first, min(size, buckets - first)) for i, first in enumerate(firsts)]


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by law ``key``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sharded = shuffle_to_shards(docs, new_folder(spark, "shards"))
    return sharded.select(
        "doc_id",
        text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )
