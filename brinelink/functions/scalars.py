"""Small column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean length of a year in days, for the yearly cycle.
YEAR_DAYS = 365.25


def micros(time: Column) -> Column:
    """Zone-free time as microseconds since the epoch (session zone is UTC)."""
    return F.unix_micros(time.cast("timestamp"))


def time_gap_s(a: Column, b: Column) -> Column:
    """Absolute gap of two times in seconds."""
    return F.abs(micros(a) - micros(b)) / 1e6


def yearly_cycle(time: Column) -> tuple[Column, Column]:
    """(sin, cos) of the day of year."""
    angle = F.dayofyear(time).cast("double") * (2 * math.pi) / YEAR_DAYS
    return F.sin(angle), F.cos(angle)


def longitude_cycle(lon: Column) -> tuple[Column, Column]:
    """(sin, cos) of the longitude."""
    return F.sin(F.radians(lon)), F.cos(F.radians(lon))


def one_hot(value: Column, code: int) -> Column:
    """1.0 where ``value`` equals ``code``; unknown values give 0.0."""
    return F.coalesce((value == code).cast("double"), F.lit(0.0))


def finite(value: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def prefer_adjusted(adjusted: Column, raw: Column) -> Column:
    """Delayed-mode value where it is finite, else the real-time one where that is."""
    return F.coalesce(finite(adjusted), finite(raw))


def residual(truth: Column, observed: Column) -> Column:
    """Training target: what must be added to the observation."""
    return truth - observed


def apply_residual(observed: Column, correction: Column) -> Column:
    return observed + correction


def round_half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def log10_count(count: Column) -> Column:
    """log10 of a positive count, NULL for an empty cell."""
    return F.when(count > 0, F.log10(count))


def parse_cycle_path(path: Column) -> tuple[Column, Column]:
    """(cycle_date, cycle_hour) out of a ``.../<prefix>.YYYYMMDD/HH/...`` path; NULL if malformed."""
    day = F.regexp_extract(path, r"\.(\d{8})/(?:00|06|12|18)(?:/|$)", 1)
    hour = F.regexp_extract(path, r"\.\d{8}/(00|06|12|18)(?:/|$)", 1)
    date = F.try_to_timestamp(F.when(day != "", day), F.lit("yyyyMMdd")).cast("date")
    return date, F.when(date.isNotNull() & (hour != ""), hour)
