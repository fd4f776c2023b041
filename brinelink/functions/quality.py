"""Sensor quality rules and range filters as Column predicates."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default limits of the checks.
MIN_SALINITY = 20.0
MAX_SALINITY = 42.0
MAX_DEPTH = 5.0
MAX_DIST_KM = 50.0
MAX_TIME_GAP_S = 3 * 3600
MAX_ABS_DIFF = 10.0
CYCLE_WINDOW = 4
EARLIEST_TIME = datetime(2000, 1, 1)
LATEST_TIME = datetime(2030, 1, 1)

# What a passing quality value is, by sensor.  The first sensor reports a
# bit mask (0 = no complaint), the second an uncertainty index with a catch-all at 999.
QUALITY_RULES: dict[str, Callable[[Column], Column]] = {
    "smap": lambda preqc: preqc == 0,
    "smos": lambda preqc: preqc < 600,
}


def quality_pass(sensor: str, preqc: Column) -> Column:
    """True where the retrieval passes its sensor's rule; a missing value does not pass."""
    return F.coalesce(QUALITY_RULES[sensor](preqc), F.lit(False))


def in_range(value: Column, low: float = MIN_SALINITY, high: float = MAX_SALINITY) -> Column:
    """Inclusive range test that is false, not null, for a missing value."""
    return F.coalesce(value.between(low, high), F.lit(False))


def near_surface(depth: Column, max_depth: float = MAX_DEPTH) -> Column:
    return F.coalesce(depth <= max_depth, F.lit(False))


def plausible_time(time: Column, low: datetime = EARLIEST_TIME, high: datetime = LATEST_TIME) -> Column:
    """Inclusive guard on a zone-free time."""
    bounds = [F.lit(str(b)).cast("timestamp_ntz") for b in (low, high)]
    return F.coalesce(time.between(*bounds), F.lit(False))


def epoch_to_time(seconds: Column) -> Column:
    """Epoch seconds to a zone-free UTC time."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, once, right after the scan.

    Spark orders NaN above every number and averages it in, so it must not travel.
    """
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )
