"""Spherical geometry and the nested cell grid, all as Column expressions.

The grid at base size ``h`` degrees has latitude bands ``0 .. ceil(180/h)-1``.  A band
is cut into ``n`` longitude cells, ``n`` shrinking towards the poles so that a cell is
never narrower than ``h`` degrees of arc.  Level ``k`` divides both sides of every base
cell by ``8**k``; scaling by a power of two is exact in floating point, so the levels
nest without gaps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in km.
EARTH_RADIUS_KM = 6371.0

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0
HALF_TURN_KM = math.pi * EARTH_RADIUS_KM

LEVEL_BITS = 3
_CELL_BITS = 30
_EDGE = 2.0**-30


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the argument of asin is clamped so antipodes stay finite."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def distance_mm(distance_km: Column) -> Column:
    """Distance as whole millimetres: the sort key that makes equal distances tie."""
    return F.floor(distance_km * 1e6 + 0.5).cast("long")


def unit_vector(lat: Column, lon: Column) -> Column:
    """Point on the unit sphere as struct(x, y, z)."""
    cos_lat = F.cos(F.radians(lat))
    return F.struct(
        (cos_lat * F.cos(F.radians(lon))).alias("x"),
        (cos_lat * F.sin(F.radians(lon))).alias("y"),
        F.sin(F.radians(lat)).alias("z"),
    )


def chord_squared(u: Column, v: Column) -> Column:
    """Squared straight-line distance of two unit vectors; rises with the arc."""
    dx, dy, dz = u["x"] - v["x"], u["y"] - v["y"], u["z"] - v["z"]
    return dx * dx + dy * dy + dz * dz


def chord_to_km(chord_sq: Column) -> Column:
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(chord_sq) / 2))


def km_to_chord(km: Column) -> Column:
    """Straight-line distance on the unit sphere of an arc; of more than half a turn the whole diameter."""
    return 2.0 * F.sin(F.least(km / (2.0 * EARTH_RADIUS_KM), F.lit(math.pi / 2)))


def band_position(lat: Column, h: Column) -> Column:
    """Fractional band number; the north pole belongs to the last band."""
    return F.least((lat + 90.0) / h, F.ceil(F.lit(180.0) / h) - _EDGE)


def cells_in_band(band: Column, h: Column) -> Column:
    """Number of base cells around one base band, from its edge nearer the pole."""
    poleward = F.greatest(F.abs(band * h - 90.0), F.abs((band + 1) * h - 90.0))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(poleward, F.lit(90.0)))) * 360.0 / h)).cast("long")


def cell_position(lon: Column, n_cells: Column) -> Column:
    """Fractional cell number in a band of ``n_cells``; any longitude convention is accepted."""
    turn = F.pmod((lon + 180.0) / 360.0, F.lit(1.0))
    return F.least(turn * n_cells, n_cells - _EDGE)


def cell_key(band: Column, cell: Column) -> Column:
    return F.shiftleft(band.cast("long"), _CELL_BITS).bitwiseOR(cell.cast("long"))


def key_band(key: Column) -> Column:
    return F.shiftright(key, _CELL_BITS)


def key_cell(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << _CELL_BITS) - 1))


def level_key(x: Column, z: Column, level: int) -> Column:
    """Cell key at ``level`` of a point at band position ``x`` and cell position ``z``."""
    scale = float(1 << (LEVEL_BITS * level))
    return cell_key(F.floor(x * scale), F.floor(z * scale))


def level_disc(key: Column, h: Column, level: int) -> Column:
    """struct(lat, lon, radius_km) of a disc holding every point of a cell.

    From the middle of the cell any of its points is reached by going along the middle
    parallel and then along a meridian, which bounds the radius.
    """
    shift = LEVEL_BITS * level
    scale = float(1 << shift)
    n_cells = cells_in_band(F.shiftright(key_band(key), shift), h)
    lat = (key_band(key) + 0.5) / scale * h - 90.0
    lon = (key_cell(key) + 0.5) / scale / n_cells * 360.0 - 180.0
    half_lat = h / scale / 2
    half_lon = F.lit(180.0) / n_cells / scale
    radius = (half_lat + F.cos(F.radians(lat)) * half_lon) * KM_PER_DEGREE
    return F.struct(lat.alias("lat"), lon.alias("lon"), radius.alias("radius_km"))


def disc_bands(lat: Column, radius_km: Column, h: Column) -> Column:
    """Array of base bands touched by a disc."""
    reach = radius_km * (1 + 1e-9) / KM_PER_DEGREE + 1e-9
    last = F.ceil(F.lit(180.0) / h) - 1
    low = F.greatest(F.floor((lat - reach + 90.0) / h), F.lit(0)).cast("long")
    high = F.least(F.floor((lat + reach + 90.0) / h), last).cast("long")
    return F.sequence(F.least(low, high), high)


def disc_cells(lat: Column, lon: Column, radius_km: Column, band: Column, h: Column) -> Column:
    """Array of consecutive cell numbers of one band touched by a disc.

    Numbers run past the date line; take them modulo the cells of the band.  A disc that
    reaches a pole touches every longitude.
    """
    n_cells = cells_in_band(band, h)
    reach = radius_km * (1 + 1e-9) / KM_PER_DEGREE + 1e-9
    over_pole = F.abs(lat) + reach >= 90.0
    width = F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    ratio = F.least(F.lit(1.0), F.sin(F.radians(F.least(reach, F.lit(90.0)))) / width)
    half = F.when(over_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)) + 1e-9)
    low = F.floor((lon - half + 180.0) / 360.0 * n_cells)
    high = F.floor((lon + half + 180.0) / 360.0 * n_cells)
    return F.sequence(low, F.least(high, low + n_cells - 1))
