"""Great-circle and grid expressions (degrees in, kilometres out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.32
MERCATOR_HALF = 20037508.342789244


def hav_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / F.lit(2.0)), F.lit(2.0))
    b = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / F.lit(2.0)), F.lit(2.0))
    return F.lit(2.0) * F.lit(EARTH_KM) * F.asin(F.sqrt(a + b))


#: The same distance as SQL text over aliases ``a`` and ``b``.
HAV_SQL = (
    "2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2e0), 2e0)"
    " + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2e0), 2e0)))"
)


def cell_row(lat: Column, res: float = 1.0) -> Column:
    return F.floor((F.lit(90.0) - lat) / F.lit(res)).cast("int")


def cell_col(lon: Column, res: float = 1.0) -> Column:
    return F.floor((lon + F.lit(180.0)) / F.lit(res)).cast("int")


def cell_area_km2(lat: Column, res: float = 1.0) -> Column:
    return F.lit((res * KM_PER_DEGREE) ** 2) * F.cos(F.radians(lat))


def mercator_x(lon: Column) -> Column:
    return lon * F.lit(MERCATOR_HALF / 180.0)


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan((F.lit(90.0) + lat) * F.lit(3.141592653589793 / 360.0))) * F.lit(MERCATOR_HALF / 3.141592653589793)


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """West, south, east and north of a web-mercator tile, in metres."""
    size = 2 * MERCATOR_HALF / 2**z
    return -MERCATOR_HALF + x * size, MERCATOR_HALF - (y + 1) * size, -MERCATOR_HALF + (x + 1) * size, MERCATOR_HALF - y * size


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def wrap_lon(lon: Column) -> Column:
    """Longitude from -180 up to, not including, 180."""
    return (((lon + F.lit(180.0)) % F.lit(360.0)) + F.lit(360.0)) % F.lit(360.0) - F.lit(180.0)


def tile_count(z: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Tiles of zoom ``z`` (two columns by one row at zoom 0) that a box covers."""
    span = F.lit(180.0) / F.pow(F.lit(2.0), z)
    across = F.least(F.pow(F.lit(2.0), z + 1), F.ceil((clip(east, -180.0, 180.0) + 180.0) / span)) - F.greatest(
        F.lit(0), F.floor((clip(west, -180.0, 180.0) + 180.0) / span)
    )
    down = F.least(F.pow(F.lit(2.0), z), F.ceil((90.0 - clip(south, -90.0, 90.0)) / span)) - F.greatest(
        F.lit(0), F.floor((90.0 - clip(north, -90.0, 90.0)) / span)
    )
    return F.greatest(across, F.lit(0)) * F.greatest(down, F.lit(0))


def zoom(west: Column, south: Column, east: Column, north: Column, pixel: float, tile_px: int, most: int, deepest: int) -> Column:
    """Zoom at which a pixel is at most ``pixel`` degrees wide (``deepest`` at most), lowered until ``most`` tiles are enough."""
    wanted = next((z for z in range(deepest) if 180.0 / 2**z / tile_px <= pixel), deepest)
    fits = F.filter(F.sequence(F.lit(0), F.lit(wanted)), lambda z: (z == 0) | (tile_count(z, west, south, east, north) <= most))
    return F.array_max(fits)
