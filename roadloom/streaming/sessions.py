"""Session logs and GPS feeds as streams with state, in order of event time however the rows come."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadloom.operators.sessions import DRAG, END, FIX, FOLLOW, GPS_OFF, LOG, START
from roadloom.operators.tracking import keep_fix, latest_request

_NAMES = [c.split()[0] for c in LOG.split(", ")]
_ASKED = "session_id bigint, device_id bigint, ts_ms bigint, event_id bigint, start struct<lat_e7: int, lon_e7: int>, end struct<lat_e7: int, lon_e7: int>"
_KEPT = "event_id bigint, device_id bigint, ts_ms bigint, accuracy double, lat_e7 int, lon_e7 int, moved boolean"
_WHOLE = ("event_id", "device_id", "session_id", "ts_ms", "lat_e7", "lon_e7")


def _plain(name: str, value: object) -> object:
    """A cell of a pandas row as Python has it."""
    if value is None or value != value:
        return None
    return int(value) if name in _WHOLE else bool(value) if name == "flag" else value


class Reordered(StatefulProcessor):
    """Holds a device's rows until the watermark has passed them, then folds them in order of ``(ts_ms, event_id)``.

    Rows that the watermark has passed on arrival are dropped before they come here, so what is folded is
    never preceded by what comes later: results don't depend on how the input falls into batches. A device has one
    timer, at its oldest row. Its state is the rows that wait, as many as come in the watermark's delay, and the fold's own.
    """

    output = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", LOG)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def fold(self, device_id: int, rows: Iterable[dict]) -> list[tuple]:
        raise NotImplementedError

    def _wake(self, ts_ms: int) -> None:
        timers = list(self.handle.listTimers())
        if not timers or ts_ms < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ts_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = [tuple(_plain(n, v) for n, v in zip(_NAMES, r, strict=True)) for batch in rows for r in batch[_NAMES].itertuples(index=False, name=None)]
        if came:
            self.waiting.appendList(came)
            self._wake(min(r[_NAMES.index("ts_ms")] for r in came))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = [dict(zip(_NAMES, r, strict=True)) for r in self.waiting.get()]
        due = sorted((r for r in held if r["ts_ms"] <= passed), key=lambda r: (r["ts_ms"], r["event_id"]))
        left = [tuple(r.values()) for r in held if r["ts_ms"] > passed]
        if left:
            self.waiting.put(left)
            # the timer that has expired goes when this is over
            self.handle.registerTimer(min(r[_NAMES.index("ts_ms")] for r in left))
        else:
            self.waiting.clear()
        out = self.fold(int(key[0]), due)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.output.replace("struct<lat_e7: int, lon_e7: int>", "struct").split(", ")])


class KeptFixes(Reordered):
    """The keep rule, with the last kept fix as state."""

    output = _KEPT

    def __init__(self, improve_only: bool = False) -> None:
        self.improve_only = improve_only

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts_ms bigint, accuracy double, lat_e7 int, lon_e7 int")

    def fold(self, device_id: int, rows: Iterable[dict]) -> list[tuple]:
        ts, accuracy, *at = self.last.get() if self.last.exists() else (None, None, None, None)
        out = []
        for r in rows:
            if keep_fix(r["ts_ms"], r["accuracy"], ts, accuracy, self.improve_only):
                now = [r["lat_e7"], r["lon_e7"]]
                ts, accuracy, moved, at = r["ts_ms"], r["accuracy"], now != at, now
                out.append((r["event_id"], device_id, ts, accuracy, *at, moved))
        if ts is not None:
            self.last.update((ts, accuracy, *at))
        return out


class SessionLog(Reordered):
    """What a device's sessions ask for; its state is the last kept fix, the position, and a row for each session."""

    output = _ASKED

    def __init__(self, improve_only: bool = False) -> None:
        self.improve_only = improve_only

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.device = handle.getValueState("device", "ts_ms bigint, accuracy double, lat_e7 int, lon_e7 int")
        ends = ", ".join(f"{e}_lat int, {e}_lon int" for e in ("start", "end", "from", "to"))
        self.sessions = handle.getMapState("sessions", "session_id bigint", f"follow boolean, dragging boolean, {ends}")

    def fold(self, device_id: int, rows: Iterable[dict]) -> list[tuple]:
        ts, accuracy, *gps = self.device.get() if self.device.exists() else (None, None, None, None)
        held = {k[0]: list(v) for k, v in self.sessions.iterator()}
        changed: set[int] = set()
        out: list[tuple] = []

        def ask(session_id: int, r: dict) -> None:
            follow, dragging, *ends = held[session_id]
            if dragging:
                return
            chosen, end, asked = ends[:2], ends[2:4], ends[4:]
            start = (gps if gps[0] is not None else chosen) if follow else (chosen if chosen[0] is not None else gps)
            now = [*start, *end] if start[0] is not None and end[0] is not None else [None] * 4
            if now != asked:
                held[session_id][6:] = now
                changed.add(session_id)
                point = lambda at: {"lat_e7": at[0], "lon_e7": at[1]} if at[0] is not None else None
                out.append((session_id, device_id, r["ts_ms"], r["event_id"], point(now[:2]), point(now[2:])))

        for r in rows:
            kind, at = r["kind"], [r["lat_e7"], r["lon_e7"]]
            if kind in (FIX, GPS_OFF):
                if kind == FIX:
                    if not keep_fix(r["ts_ms"], r["accuracy"], ts, accuracy, self.improve_only):
                        continue
                    ts, accuracy = r["ts_ms"], r["accuracy"]
                gps = at if kind == FIX else [None, None]
                for session_id in held:
                    ask(session_id, r)
                continue
            own = held.setdefault(r["session_id"], [True, False, *[None] * 8])
            at = at if None not in at else [None, None]
            own[{FOLLOW: slice(0, 1), DRAG: slice(1, 2), START: slice(2, 4), END: slice(4, 6)}[kind]] = at if kind in (START, END) else [r["flag"]]
            changed.add(r["session_id"])
            ask(r["session_id"], r)
        self.device.update((ts, accuracy, *gps))
        for session_id in changed:
            self.sessions.updateValue((session_id,), tuple(held[session_id]))
        return out


def _in_order(log: DataFrame, rule: Reordered, delay: str) -> DataFrame:
    timed = log.select(*_NAMES, F.timestamp_millis("ts_ms").alias("_at")).withWatermark("_at", delay)
    return timed.groupBy("device_id").transformWithStateInPandas(rule, rule.output, "Append", "EventTime")


def kept_fixes_stream(fixes: DataFrame, delay: str, improve_only: bool = False) -> DataFrame:
    """``filter_gps_stream`` for fixes that come out of order by up to ``delay``, across micro-batches too: the batch's result.

    ``fixes`` is a log (``event_log``) whose other rows are ignored. Fixes later than ``delay`` are dropped. Needs the RocksDB state store.
    """
    return _in_order(fixes.where(F.col("kind") == FIX), KeptFixes(improve_only), delay)


def session_requests_stream(log: DataFrame, delay: str, improve_only: bool = False) -> DataFrame:
    """``session_requests`` of a log that comes as a stream, out of order by up to ``delay``: the batch's result for any split into batches.

    Rows later than that are dropped; those of the last ``delay`` wait for newer ones. Needs the RocksDB state store.
    """
    return _in_order(log, SessionLog(improve_only), delay)


def reroute_sessions(log: DataFrame, route: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, delay: str):
    """Starts the query that routes a session anew when what it asks for changes; returns the streaming query.

    Of a batch's requests only the newest of a session is routed; where a session no longer has both ends, its row has nulls in place of a
    route. Each batch's rows go to a folder of its own, so a batch that runs again after a failure replaces its first try.
    """

    def each(batch: DataFrame, number: int) -> None:
        now = latest_request(batch).select(F.col("session_id").alias("request_id"), "device_id", "ts_ms", "start", "end")
        routed = route(now.where("end IS NOT NULL").select("request_id", "start", "end"))
        rows = now.select("request_id", "device_id", "ts_ms").join(routed, "request_id", "left")
        rows.withColumnRenamed("request_id", "session_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = session_requests_stream(log, delay).writeStream.foreachBatch(each)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
