"""GPS feeds as streams: the keep rule with state per device, and re-routing as sessions move."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadloom.functions.geo import to_e7
from roadloom.functions.requests import choose_start
from roadloom.jobs.routing import find_routes
from roadloom.operators.tracking import keep_fix, latest_request

FIX = "event_id bigint, device_id bigint, ts_ms bigint, accuracy double, lat double, lon double"
_OUT = "event_id bigint, device_id bigint, ts_ms bigint, accuracy double, lat_e7 int, lon_e7 int, moved boolean"


def read_gps_stream(spark: SparkSession, source: str | DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Fixes as they come, from a folder of Parquet files or from any stream, such as one of Kafka.

    A stream has a column ``value`` with a fix in JSON, or the columns of ``FIX`` under their names. Fixes without
    a position, device, time or accuracy are ignored, as is JSON that can't be read.
    """
    if isinstance(source, str):
        reader = spark.readStream.schema(FIX)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(source).dropna()
    names = [c.split()[0] for c in FIX.split(", ")]
    if not set(names) <= set(source.columns):
        source = source.select(F.from_json(F.col("value").cast("string"), FIX).alias("fix")).select("fix.*")
    return source.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in FIX.split(", "))).dropna()


def filter_gps_stream(fixes: DataFrame, improve_only: bool = False, idle_ms: int | None = None) -> DataFrame:
    """Kept fixes with their position in E7, and whether it ``moved`` from the one kept before.

    The state is the last kept fix and lives by device. With ``idle_ms``, devices
    silent for as long in processing time are forgotten, and their next fix is kept, as the
    rule keeps it after 10 s anyway; such a query goes on even when its input ends. Within a micro-batch fixes are folded by
    ``(ts_ms, event_id)``, so results equal the batch's unless disorder crosses batches.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ts, accuracy, lat, lon = state.get if state.exists else (None, None, None, None)
        rows = []
        for r in pd.concat(list(batches)).sort_values(["ts_ms", "event_id"]).itertuples():
            if not keep_fix(r.ts_ms, r.accuracy, ts, accuracy, improve_only):
                continue
            moved = (lat, lon) != (r.lat_e7, r.lon_e7)
            ts, accuracy, lat, lon = int(r.ts_ms), float(r.accuracy), int(r.lat_e7), int(r.lon_e7)
            rows.append((r.event_id, key[0], ts, accuracy, lat, lon, moved))
        state.update((ts, accuracy, lat, lon))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    e7 = fixes.select("event_id", "device_id", "ts_ms", "accuracy", to_e7(F.col("lat")).alias("lat_e7"), to_e7(F.col("lon")).alias("lon_e7"))
    return e7.groupBy("device_id").applyInPandasWithState(
        run, _OUT, "ts bigint, accuracy double, lat int, lon int", "append", timeout
    )


def reroute_stream(
    fixes: DataFrame, sessions: DataFrame, route: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
):
    """Starts the query that routes every session anew when its device moves; returns the streaming query.

    ``sessions(session_id, device_id, follow_gps, start, end)`` is read anew in each
    batch. Of a batch's positions only the newest of a session is routed, and only
    where both ends are known. Each batch's routes go to a folder of its own, so a
    batch that runs again after a failure replaces its first try.
    """
    at = F.struct("lat_e7", "lon_e7").alias("gps")

    def each(batch: DataFrame, number: int) -> None:
        moved = batch.where("moved").select("device_id", "event_id", "ts_ms", at)
        now = latest_request(moved.join(sessions, "device_id"))
        start = choose_start(F.col("follow_gps"), F.col("start"), F.col("gps")).alias("start")
        wanted = now.select(F.col("session_id").alias("request_id"), "ts_ms", start, "end").where("start IS NOT NULL AND end IS NOT NULL")
        routed = route(wanted.select("request_id", "start", "end")).join(wanted.select("request_id", "ts_ms"), "request_id")
        routed.withColumnRenamed("request_id", "session_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return filter_gps_stream(fixes).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def router(nodes: DataFrame, edges: DataFrame, details: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``find_routes`` over one graph."""
    return lambda requests: find_routes(requests, nodes, edges, details)
