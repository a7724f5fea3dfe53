"""Which endpoints a session routes between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choose_start(follow_gps: Column, start: Column, gps: Column) -> Column:
    """The GPS position first while it is followed, else the chosen start; the other one where that is null."""
    return F.when(follow_gps, F.coalesce(gps, start)).otherwise(F.coalesce(start, gps))


def routable_requests(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with both ends; the others have no route."""
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull())


def settled_only(df: DataFrame, point: str) -> DataFrame:
    """Rows whose point is set and not being dragged."""
    return df.where(~F.col("is_dragging") & F.col(point).isNotNull())
