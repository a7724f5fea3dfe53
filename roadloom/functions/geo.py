"""Coordinates, grid cells and Web Mercator pixels as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 256
BLOCK_BITS = 10


@dataclass(frozen=True)
class Grid:
    """A graph's grid, in degrees times 1e7."""

    base_lon: int
    base_lat: int
    cell_width: int
    cell_height: int
    width: int
    height: int


def to_e7(deg: Column) -> Column:
    """Degrees to int E7, half up: ``floor(deg * 1e7 + 0.5)``; null stays null."""
    return F.floor(deg * 1e7 + 0.5).cast("int")


def e6_to_e7(e6: Column) -> Column:
    return (e6 * 10).cast("int")


def _tenth(e7: Column) -> Column:
    # integer division goes toward zero
    return F.when(e7 >= 0, F.floor(e7 / 10)).otherwise(F.ceil(e7 / 10))


def e7_to_e6(e7: Column) -> Column:
    return _tenth(e7).cast("int")


def e7_to_deg(e7: Column) -> Column:
    return e7 / F.lit(1e7)


def snap_e6(e7: Column) -> Column:
    """Drops the last digit, as a round trip over E6 does."""
    return (_tenth(e7) * 10).cast("int")


def format_position(lat: Column, lon: Column) -> Column:
    """``[+48.7456169 N  +9.1070623 W]``; the fixed format says W for east."""
    return F.format_string("[%+12.7f N %+12.7f W]", e7_to_deg(lat), e7_to_deg(lon))


def split_node_id(node: Column) -> tuple[Column, Column]:
    """``(block, index)`` of a packed node id."""
    return F.shiftrightunsigned(node, BLOCK_BITS), node.bitwiseAND((1 << BLOCK_BITS) - 1)


def is_core(node: Column, core_block: int) -> Column:
    """Whether the node's block is of the core; without a core (-1) no node is."""
    return F.lit(False) if core_block < 0 else split_node_id(node)[0] >= core_block


def _axis(value: Column, base: int, size: int, count: int) -> Column:
    offset = (value.cast("bigint") - base) / size
    whole = F.when(offset >= 0, F.floor(offset)).otherwise(F.ceil(offset))
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), whole.cast("bigint"))).cast("int")


def grid_xy(lon: Column, lat: Column, grid: Grid) -> tuple[Column, Column]:
    """Column and row of a position's cell; positions outside belong to the nearest edge cell."""
    return (
        _axis(lon, grid.base_lon, grid.cell_width, grid.width),
        _axis(lat, grid.base_lat, grid.cell_height, grid.height),
    )


def grid_cell(lon: Column, lat: Column, grid: Grid) -> Column:
    x, y = grid_xy(lon, lat, grid)
    return y * grid.width + x


def mercator_px(lon: Column, lat: Column, zoom: Column | int = 0) -> tuple[Column, Column]:
    """Web Mercator pixel x and y of degrees, for tiles of 256 pixels."""
    size = TILE * F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    s = F.sin(F.radians(lat))
    return (lon + 180) / 360 * size, (0.5 - F.log((1 + s) / (1 - s)) / (4 * pi)) * size


def mercator_inverse(x: Column, y: Column, zoom: Column | int = 0) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel."""
    size = TILE * F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    return x / size * 360 - 180, F.degrees(F.atan(F.sinh((0.5 - y / size) * (2 * pi))))


def viewport_rect(lat: Column, lon: Column, zoom: Column, pixels: int = 4096) -> dict[str, Column]:
    """Latitudes and longitudes of a window of ``pixels`` around a centre."""
    x, y = mercator_px(lon, lat, zoom)
    half = pixels / 2
    left, top = mercator_inverse(x - half, y - half, zoom)
    right, bottom = mercator_inverse(x + half, y + half, zoom)
    return {"lat_min": bottom, "lat_max": top, "lon_min": left, "lon_max": right}


def in_geo_rect(lat: Column, lon: Column, lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """Bounds are inclusive."""
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)
