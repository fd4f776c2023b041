"""Recovering the instrument behind a profile from an index, and attaching it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelink.functions import geo
from brinelink.functions.scalars import time_gap_s
from brinelink.operators.nearest import KeptPoints, keep_points, nearest, nearest_kept
from brinelink.session import cut_lineage

PROFILE_ID = ["argo_lat", "argo_lon", "argo_datetime"]

# How near in space and time an index entry must be to be the same profile.
MAX_INDEX_DIST_KM = 1.0
MAX_INDEX_GAP_S = 600

#: Positions of a cell that a query is measured against one by one; a round through summaries costs more than these.
HOT_INDEX_CELL = 1024
#: Cells of the kept index, about 3.5 km, and the radii of its rings in parts of one.
KEPT_CELL_DEG = 1 / 32
RINGS = (1 / 128, 1 / 2)
_CELL_SIZES = (1 / 64, 1 / 8, 1.0, 8.0, 45.0)


def unique_profiles(*matchups: DataFrame) -> DataFrame:
    """Distinct profile identities over several matchup tables."""
    return reduce(DataFrame.unionByName, [m.select(*PROFILE_ID) for m in matchups]).distinct()


def _cell_size(part: Column) -> Column:
    size = F.lit(_CELL_SIZES[-1])
    for i, deg in enumerate(_CELL_SIZES[:-1]):
        size = F.when(part == i, F.lit(deg)).otherwise(size)
    return size


def _all_sizes(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(len(_CELL_SIZES))])))


def _own_cell(lat: Column, lon: Column, size: Column) -> Column:
    x = geo.band_position(lat, size)
    z = geo.cell_position(lon, geo.cells_in_band(F.floor(x), size))
    return F.coalesce(geo.level_key(x, z, 0), F.lit(-1).cast("long"))


def nearest_position(asked: DataFrame, positions: DataFrame, hot_cell: int = HOT_INDEX_CELL) -> DataFrame:
    """Nearest of ``positions`` (lat, lon) to each of ``asked`` (lat, lon), however far.

    One position is remembered per cell for a few cell sizes.  The remembered positions
    of the cells a query lies in bound its distance, and the bound picks the cell size at
    which a handful of cells is certain to hold the nearest position.
    """
    size = _cell_size(F.col("part"))
    placed = _all_sizes(positions)
    remembered = (
        placed.withColumn("cell", _own_cell(F.col("lat"), F.col("lon"), size))
        .groupBy("part", "cell")
        .agg(F.min(F.struct("lat", "lon")).alias("known"))
    )
    bound = (
        _all_sizes(asked)
        .withColumn("cell", _own_cell(F.col("lat"), F.col("lon"), size))
        .join(remembered, ["part", "cell"], "left")
        .groupBy("lat", "lon")
        .agg(F.min(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("known.lat"), F.col("known.lon"))).alias("km"))
        .select("lat", "lon", F.coalesce(F.col("km") + 1e-6, F.lit(geo.HALF_TURN_KM + 1)).alias("radius_km"))
    )
    part = F.lit(len(_CELL_SIZES) - 1)
    for i in reversed(range(len(_CELL_SIZES) - 1)):
        part = F.when(F.col("radius_km") <= _CELL_SIZES[i] * geo.KM_PER_DEGREE, F.lit(i)).otherwise(part)
    found = nearest(bound.withColumn("part", part), placed, [], size, hot_cell)
    return found.select("lat", "lon", F.col("hit.lat").alias("near_lat"), F.col("hit.lon").alias("near_lon"))


def keep_index(index: DataFrame, hot_cell: int = HOT_INDEX_CELL, buckets: int | None = None) -> KeptPoints:
    """The index as a kept table: of several entries at one position the earliest stands for it."""
    entry = F.struct("date", "wmo", "cyc", "file", "dac")
    placed = index.dropna(subset=["latitude", "longitude"])
    by_position = placed.groupBy(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(F.min(entry).alias("entry"))
    return keep_points(by_position, ["entry"], KEPT_CELL_DEG, hot_cell, buckets)


def _nearest_kept_entry(asked: DataFrame, kept: KeptPoints, hot_cell: int) -> DataFrame:
    """Nearest entry of every position: argo_lat, argo_lon, near_lat, near_lon, entry.

    Rings grow around the positions that are left: whatever a ring holds, its nearest is the answer. Positions that the last ring
    holds nothing for, few where the index covers the profiles, are searched at any distance.
    """
    out = ["lat", "lon", "near_lat", "near_lon", "entry"]
    rings, rest = [], asked
    for part in RINGS:
        ring = rest.withColumn("radius_km", F.lit(part * kept.cell_deg * geo.KM_PER_DEGREE))
        found = nearest_kept(ring, kept, hot_cell)
        found = cut_lineage(found.select("lat", "lon", F.col("hit.lat").alias("near_lat"), F.col("hit.lon").alias("near_lon"), "hit.entry"))
        rings.append(found)
        rest = cut_lineage(rest.join(found, ["lat", "lon"], "left_anti"))
        if rest.isEmpty():
            break
    else:
        entries = kept.table.select(F.col("point.lat").alias("near_lat"), F.col("point.lon").alias("near_lon"), "point.entry")
        far = nearest_position(rest, entries.select(F.col("near_lat").alias("lat"), F.col("near_lon").alias("lon")), hot_cell)
        rings.append(far.join(entries, ["near_lat", "near_lon"]).select(*out))
    return reduce(DataFrame.unionByName, rings).withColumnsRenamed({"lat": "argo_lat", "lon": "argo_lon"})


def match_to_index(
    profiles: DataFrame,
    index: DataFrame | KeptPoints,
    max_dist_km: float = MAX_INDEX_DIST_KM,
    max_gap_s: float = MAX_INDEX_GAP_S,
    hot_cell: int = HOT_INDEX_CELL,
) -> DataFrame:
    """Nearest index entry of every profile, flagged ``matched`` when close enough.

    Space alone picks the entry, at any distance; distance and time only set the flag.
    Of several entries at one position the earliest stands for it. ``index`` is the table or, to
    search it again and again, what ``keep_index`` made of it.
    """
    kept = index if isinstance(index, KeptPoints) else keep_index(index, hot_cell)
    asked = profiles.select(F.col("argo_lat").alias("lat"), F.col("argo_lon").alias("lon")).dropna().distinct()
    near = _nearest_kept_entry(asked, kept, hot_cell)
    joined = profiles.join(near, ["argo_lat", "argo_lon"], "left").select(
        *profiles.columns,
        "entry.wmo",
        "entry.cyc",
        "entry.file",
        "entry.dac",
        F.col("entry.date").alias("index_date"),
        geo.haversine_km(F.col("argo_lat"), F.col("argo_lon"), F.col("near_lat"), F.col("near_lon")).alias("dist_km"),
        time_gap_s(F.col("argo_datetime"), F.col("entry.date")).alias("time_delta_s"),
    )
    close = (F.col("dist_km") <= max_dist_km) & (F.col("time_delta_s") <= max_gap_s)
    return joined.withColumn("matched", F.coalesce(close, F.lit(False)))


def attach_wmo(matchups: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add ``wmo`` from the matched lookup rows, keeping every matchup exactly once.

    A key that stands for two lookup rows would multiply matchups: the job fails if such
    a key is met.  An earlier ``wmo`` column is replaced, so the step can be repeated.
    """
    known = (
        lookup.where("matched")
        .groupBy(*PROFILE_ID)
        .agg(F.min("wmo").alias("wmo"), F.count(F.lit(1)).alias("times"))
    )
    checked = F.when(
        F.col("times") > 1, F.raise_error(F.lit("lookup key is not unique: attaching would change the row count")).cast("long")
    ).otherwise(F.col("wmo"))
    return (
        matchups.drop("wmo")
        .join(known, PROFILE_ID, "left")
        .withColumn("wmo", checked)
        .drop("times")
    )
