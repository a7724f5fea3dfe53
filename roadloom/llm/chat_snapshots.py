"""Chat logs: cumulative snapshots collapse to the maximal conversations, which are rendered."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import checkpointed, rows_of, table


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``(conv_id, at, prefix, last)``: for each turn the hash of its conversation up to it.

    The hash rolls over the turns in their order (by turn, role, text; nulls first),
    so a conversation of any length needs the memory of one turn. Roles and
    texts count, turn numbers don't; null differs from empty. ``last`` marks a
    conversation's last turn. Rows without conv_id belong to no conversation.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, state = None, 0, b""
        for ids, roles, texts in rows_of(batches, "conv_id", "role", "text", size=2048):
            ats, states = [], []
            for c, role, text in zip(ids, roles, texts, strict=True):
                if c != conv:
                    conv, at, state = c, 0, b""
                at += 1
                turn = [b"\0" if x is None else b"\1" + x.encode("utf-8", "surrogatepass") for x in (role, text)]
                state = blake2b(state + len(turn[0]).to_bytes(8, "big") + turn[0] + turn[1], digest_size=16).digest()
                ats.append(at)
                states.append(state)
            arrays = [pa.array(ids, pa.int64()), pa.array(ats, pa.int64()), pa.array(states, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "at", "prefix"])

    slim = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    hashed = checkpointed(dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, at long, prefix binary"))
    ends = hashed.groupBy("conv_id").agg(F.max("at").alias("n"))
    return hashed.join(ends, "conv_id").select("conv_id", "at", "prefix", (F.col("at") == F.col("n")).alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of conversations that no longer one begins with; of equal ones the smallest id."""
    hashes = checkpointed(prefix_hashes(turns))
    whole = hashes.where("last").groupBy("prefix", "at").agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.where("NOT last").select("prefix", "at").distinct()
    return whole.join(inner, ["prefix", "at"], "left_anti").select("conv_id", F.col("at").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """``(conv_id, rendered)``: each turn as ``<|role|>``, a line end, its text and a line end; nulls count as empty."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    lines = F.collect_list(F.struct("turn", F.col("role").alias("r"), F.col("text").alias("t"), line.alias("line")))
    joined = F.array_join(F.transform(F.array_sort(lines), lambda x: x.line), "")
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(joined.alias("rendered"))


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that no longer one begins with, rendered."""
    turns = table(spark, sf_dir, "conversations")
    kept = maximal(turns)
    own = turns.join(kept.select("conv_id"), "conv_id", "left_semi")
    return render(own).join(kept, "conv_id").select("conv_id", "n_turns", "rendered")


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n'), '') OVER w AS prefix
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)
), whole AS (
  SELECT prefix, pos, min(conv_id) AS conv_id FROM t WHERE pos = n GROUP BY prefix, pos
), kept AS (
  SELECT conv_id, pos AS n_turns FROM whole
  WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.pos < t.n AND t.pos = whole.pos AND t.prefix = whole.prefix)
)
SELECT c.conv_id, k.n_turns,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM conversations c JOIN kept k ON c.conv_id = k.conv_id GROUP BY c.conv_id, k.n_turns
"""
