"""Tile names and bounds, snapping, areas and distances on the ellipsoid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 semi-major axis (m) and flattening.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
# One degree on either axis of the plate carree plane (m).
PLATE_CARREE_DEGREE = SEMI_MAJOR * math.pi / 180.0

BOUNDS = ("lat0", "lat1", "lon0", "lon1")


def snap(coordinate: Column, width: float, up: bool = False) -> Column:
    """Coordinate moved to the tile grid, downwards or upwards."""
    steps = coordinate / F.lit(float(width))
    return (F.ceil(steps) if up else F.floor(steps)).cast("double") * F.lit(float(width))


def box_area(lat0: Column, lat1: Column, lon0: Column, lon1: Column) -> Column:
    return F.abs(lat1 - lat0) * F.abs(lon1 - lon0)


def patch_name(lat0: Column, lat1: Column, lon0: Column, lon1: Column) -> Column:
    return F.format_string("patch_%.0f_%.0f_%.0f_%.0f", *[F.bround(c, 0) for c in (lat0, lat1, lon0, lon1)])


def patch_bounds(name: Column) -> Column:
    """Struct of tile bounds from a directory name; NULL for a malformed name."""
    parts = F.split(name, "_")
    numbers = [
        F.when(F.get(parts, i).rlike(r"^-?\d+(\.\d+)?$"), F.get(parts, i).try_cast("double")) for i in range(1, 5)
    ]
    whole = (F.size(parts) == 5) & (F.get(parts, 0) == "patch")
    for number in numbers:
        whole = whole & number.isNotNull()
    return F.when(whole, F.struct(*[n.alias(b) for n, b in zip(numbers, BOUNDS)]))


def _meridian_arc(lat: Column) -> Column:
    """Metres along the meridian from the equator, by the series in the third flattening."""
    n = FLATTENING / (2.0 - FLATTENING)
    phi = F.radians(lat)
    return (SEMI_MAJOR / (1.0 + n)) * (
        (1.0 + n**2 / 4.0 + n**4 / 64.0) * phi
        - 1.5 * (n - n**3 / 8.0) * F.sin(2.0 * phi)
        + (15.0 / 16.0) * (n**2 - n**4 / 4.0) * F.sin(4.0 * phi)
        - (35.0 / 48.0) * n**3 * F.sin(6.0 * phi)
        + (315.0 / 512.0) * n**4 * F.sin(8.0 * phi)
    )


def meridian_meters(lat: Column, degrees: Column | float) -> Column:
    """Length in metres of ``degrees`` of latitude northwards from ``lat``."""
    step = degrees if isinstance(degrees, Column) else F.lit(float(degrees))
    return _meridian_arc(lat + step) - _meridian_arc(lat)
