"""Every near-surface profile of the archive, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelink.functions.quality import MAX_DEPTH, near_surface
from brinelink.functions.scalars import round_half_even


def coverage_scan(argo: DataFrame, max_depth: float = MAX_DEPTH) -> DataFrame:
    """Distinct (lat, lon, time) with positions to 4 places and time to the second.

    Neither salinity nor time is filtered: this is what was measured, not what was usable.
    """
    return (
        argo.where(near_surface(F.col("depth"), max_depth))
        .dropna(subset=["lat", "lon"])
        .select(
            round_half_even(F.col("lat"), 4).alias("lat"),
            round_half_even(F.col("lon"), 4).alias("lon"),
            round_half_even(F.col("original_datetime").cast("double"), 0).alias("original_datetime_epoch"),
        )
        .distinct()
    )
