"""Depth levels to one bulk value per profile, and satellite row filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelink.functions import quality as q

PROFILE_KEY = ("lat", "lon", "datetime", "oceanBasin")
CYCLE = ("cycle_date", "cycle_hour")


def with_true_time(argo: DataFrame) -> DataFrame:
    """Replace the snapped time by the true one, read from epoch seconds."""
    return argo.withColumn("datetime", q.epoch_to_time(F.col("original_datetime"))).drop("original_datetime")


def usable_condition(
    sensor: str, min_salinity: float = q.MIN_SALINITY, max_salinity: float = q.MAX_SALINITY
) -> Column:
    """What ``usable_sat`` keeps, as plain comparisons of stored columns that a scan can use.

    NaN lies above every limit, so it passes neither.
    """
    return q.QUALITY_RULES[sensor](F.col("preqc")) & F.col("sss").between(min_salinity, max_salinity)


def near_surface_condition(
    max_depth: float = q.MAX_DEPTH, min_salinity: float = q.MIN_SALINITY, max_salinity: float = q.MAX_SALINITY
) -> Column:
    """What ``near_surface_levels`` keeps, as plain comparisons of stored columns that a scan can use."""
    low, high = (int(t.replace(tzinfo=timezone.utc).timestamp()) for t in (q.EARLIEST_TIME, q.LATEST_TIME))
    return (
        (F.col("depth") <= max_depth)
        & F.col("salinity").between(min_salinity, max_salinity)
        & F.col("original_datetime").between(low, high)
    )


def near_surface_levels(
    argo: DataFrame,
    max_depth: float = q.MAX_DEPTH,
    min_salinity: float = q.MIN_SALINITY,
    max_salinity: float = q.MAX_SALINITY,
) -> DataFrame:
    """Levels that may enter a profile mean: plausible time, shallow, salinity present and in range."""
    return with_true_time(argo).where(
        q.plausible_time(F.col("datetime"))
        & q.near_surface(F.col("depth"), max_depth)
        & q.in_range(F.col("salinity"), min_salinity, max_salinity)
    )


def profile_means(levels: DataFrame, key: Sequence[str] = PROFILE_KEY, within: Sequence[str] = CYCLE) -> DataFrame:
    """Mean salinity and depth per profile; rows with a missing key part belong to no profile.

    ``within`` keeps the copies of one profile in different cycles apart.
    """
    return (
        levels.dropna(subset=list(key))
        .groupBy(*within, *key)
        .agg(F.avg("salinity").alias("salinity"), F.avg("depth").alias("depth"))
    )


def argo_profiles(argo: DataFrame, **limits: float) -> DataFrame:
    """Quality-filtered profile means per cycle."""
    return profile_means(near_surface_levels(argo, **limits))


def usable_sat(
    sat: DataFrame,
    sensor: str,
    min_salinity: float = q.MIN_SALINITY,
    max_salinity: float = q.MAX_SALINITY,
) -> DataFrame:
    """Satellite rows with a value that passes the sensor's quality rule and the range."""
    return sat.where(
        F.col("sss").isNotNull()
        & q.quality_pass(sensor, F.col("preqc"))
        & q.in_range(F.col("sss"), min_salinity, max_salinity)
    ).drop("preqc")
