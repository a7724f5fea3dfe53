"""Sessions as a log of changes: what each one asks for, as positions, ends, following and dragging change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import to_e7
from roadloom.functions.requests import choose_start
from roadloom.operators.tracking import changes_only, filter_gps

#: Kinds of a log's rows. Those in ``OF_DEVICE`` concern all sessions of their device.
FIX, GPS_OFF, START, END, FOLLOW, DRAG = KINDS = ("fix", "gps_off", "start", "end", "follow", "drag")
OF_DEVICE = (FIX, GPS_OFF)
LOG = "event_id bigint, device_id bigint, session_id bigint, ts_ms bigint, kind string, accuracy double, flag boolean, lat_e7 int, lon_e7 int"
_ORDER = ["ts_ms", "event_id"]


def event_log(fixes: DataFrame, changes: DataFrame) -> DataFrame:
    """One log of ``fixes(event_id, device_id, ts_ms, accuracy, lat, lon)`` and ``changes`` with the columns of ``LOG``; both may be streams.

    Event ids are unique over both. A change of kind ``start`` or ``end`` has a position, or nulls where the end
    is cleared; ``follow`` and ``drag`` have a flag; ``gps_off`` has no more than device and time. Rows without a device, a time or an id, of
    other kinds, of a session without an id, and fixes without a position or accuracy, are ignored.
    """
    names = [c.split()[0] for c in LOG.split(", ")]
    none = {"session_id": "bigint", "flag": "boolean"}
    at = {"kind": F.lit(FIX), "lat_e7": to_e7(F.col("lat")), "lon_e7": to_e7(F.col("lon")), **{c: F.lit(None).cast(t) for c, t in none.items()}}
    of_fix = fixes.dropna(subset=["device_id", "ts_ms", "accuracy", "lat", "lon"]).select(*(at[c].alias(c) if c in at else c for c in names))
    own = changes.where(F.col("kind").isin(*KINDS[1:]) & (F.col("session_id").isNotNull() | F.col("kind").isin(*OF_DEVICE)))
    flagged = F.col("flag").isNotNull() | ~F.col("kind").isin(FOLLOW, DRAG)
    return of_fix.unionByName(own.where(flagged).select(*names)).dropna(subset=["event_id", "device_id", "ts_ms"])


def _point(kind: Column) -> Column:
    """The row's position, null where there is none, wrapped so that a cleared one counts as known."""
    at = F.when(F.col("lat_e7").isNotNull() & F.col("lon_e7").isNotNull(), F.struct("lat_e7", "lon_e7"))
    return F.when(kind, F.struct(at.alias("at")))


def session_requests(log: DataFrame, improve_only: bool = False) -> DataFrame:
    """``(session_id, device_id, ts_ms, event_id, start, end)``: a row where what a session asks for changes.

    A session is there from its first change on; it follows the GPS until told otherwise, has no ends and isn't dragged. Positions
    are the device's kept fixes (``filter_gps``), until the GPS goes off. The start is the position or the chosen
    one (``choose_start``). While a session is dragged nothing is asked; its release asks for the newest values. Both ends are null
    where a route is no longer possible. A request equal to the session's last one isn't asked again.
    """
    fixes = log.where(F.col("kind") == FIX)
    # the rule looks at positions only to drop fixes without one
    kept = filter_gps(fixes.withColumn("lat", F.lit(0.0)).withColumn("lon", F.lit(0.0)), improve_only).drop("lat", "lon")
    of_device = kept.unionByName(log.where(F.col("kind") == GPS_OFF)).drop("session_id")
    own = log.where(~F.col("kind").isin(*OF_DEVICE))
    known = own.groupBy("session_id", "device_id").agg(F.min(F.struct(*_ORDER)).alias("since"))
    rows = of_device.join(known, "device_id").select(*own.columns, "since").unionByName(own.join(known, ["session_id", "device_id"]).select(*own.columns, "since"))
    w = Window.partitionBy("device_id", "session_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda value: F.last(value, ignorenulls=True).over(w)
    kind = F.col("kind")
    rows = rows.select(
        "session_id",
        "device_id",
        *_ORDER,
        "since",
        last(_point(kind.isin(*OF_DEVICE)))["at"].alias("gps"),
        last(_point(kind == START))["at"].alias("start"),
        last(_point(kind == END))["at"].alias("end"),
        F.coalesce(last(F.when(kind == FOLLOW, F.col("flag"))), F.lit(True)).alias("follow_gps"),
        F.coalesce(last(F.when(kind == DRAG, F.col("flag"))), F.lit(False)).alias("is_dragging"),
    )
    start = choose_start(F.col("follow_gps"), F.col("start"), F.col("gps"))
    asked = F.when(start.isNotNull() & F.col("end").isNotNull(), F.struct(start.alias("start"), F.col("end").alias("end"))).alias("asked")
    live = rows.where(~F.col("is_dragging") & (F.struct(*_ORDER) >= F.col("since"))).withColumn("key", F.struct("device_id", "session_id"))
    live = changes_only(live.select("key", "session_id", "device_id", *_ORDER, asked), "key", _ORDER, "asked")
    return live.select("session_id", "device_id", *_ORDER, F.col("asked.start").alias("start"), F.col("asked.end").alias("end"))
