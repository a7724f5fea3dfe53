"""GPS fixes: the keep rule, positions that change, and what a session asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import to_e7
from roadloom.operators.chunks import fold_chunks, ordered_chunks

QUIET_MS, WORSE_M = 10_000, 5.0


def keep_fix(ts_ms: int, accuracy: float, last_ts: int | None, last_accuracy: float | None, improve_only: bool = False) -> bool:
    """Whether a fix is kept, after the last one that was.

    A fix is dropped within 10 s unless its accuracy is 5 m or more larger. Accuracy
    is a radius of error, so this keeps much worse fixes early; ``improve_only``
    keeps much better ones, which seems to be meant.
    """
    if last_ts is None or last_accuracy is None:
        return True
    worse = accuracy - last_accuracy
    return ts_ms - last_ts >= QUIET_MS or (-worse if improve_only else worse) >= WORSE_M


class KeepFold:
    """The keep rule over one device's rows in order; its state is the last kept fix's time and accuracy."""

    def __init__(self, state: tuple | None, at: tuple[int, int], improve_only: bool) -> None:
        (self.last,) = state or ((None, None),)
        self.at, self.improve_only = at, improve_only

    def take(self, rows: list[tuple]) -> list[tuple]:
        ts, accuracy = self.at
        out = []
        for r in rows:
            if keep_fix(r[ts], r[accuracy], *self.last, self.improve_only):
                self.last = (r[ts], r[accuracy])
                out.append(r)
        return out

    def end(self) -> list[tuple]:
        return []

    def state(self) -> tuple:
        return (self.last,)


def sound_fixes(fixes: DataFrame) -> DataFrame:
    """Fixes with device, time, accuracy and position; the others are ignored."""
    return fixes.dropna(subset=["device_id", "ts_ms", "accuracy", "lat", "lon"])


def filter_gps(fixes: DataFrame, improve_only: bool = False, chunks: int | None = None) -> DataFrame:
    """The fixes that the keep rule keeps, for each device in order of ``(ts_ms, event_id)``.

    A device's track may be of any length: it is cut into chunks, each folded by itself (``chunks.fold_chunks``). A fix that is kept
    from two different states leads to the same state from there on, as every fix does that comes 10 s or more after the one
    before, so guesses meet the true fold within a few fixes.
    """
    dealt = ordered_chunks(sound_fixes(fixes), "device_id", "ts_ms", "event_id", chunks=chunks)
    schema = sound_fixes(fixes).schema
    at = (schema.names.index("ts_ms"), schema.names.index("accuracy"))
    make = lambda state: KeepFold(state, at, improve_only)
    return fold_chunks(dealt, "device_id", ["ts_ms", "event_id"], make, schema, [], lambda first, before: None)


def changes_only(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before it; null equals null, and a key's first row stays if it isn't null."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def gps_positions(kept: DataFrame) -> DataFrame:
    """``(device_id, event_id, ts_ms, gps)``: positions in E7 of kept fixes, where they change."""
    at = F.struct(to_e7(F.col("lat")).alias("lat_e7"), to_e7(F.col("lon")).alias("lon_e7")).alias("gps")
    return changes_only(kept.select("device_id", "event_id", "ts_ms", at), "device_id", ["ts_ms", "event_id"], "gps")


def latest_request(requests: DataFrame) -> DataFrame:
    """Of each session's requests the newest by ``(ts_ms, event_id)``; it stands for all before it."""
    columns = [c for c in requests.columns if c != "session_id"]
    newest = F.max_by(F.struct(*columns), F.struct("ts_ms", "event_id"))
    return requests.groupBy("session_id").agg(newest.alias("r")).select("session_id", *(F.col(f"r.{c}").alias(c) for c in columns))
