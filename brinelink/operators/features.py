"""Model inputs, all from the satellite observation alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinelink.functions.scalars import longitude_cycle, one_hot, residual, yearly_cycle

# The basin codes and the order of the model inputs.
BASIN_CODES = (0, 1, 2, 3, 4, 5)
FEATURE_COLUMNS = ["sat_sss", "sat_lat", "lon_sin", "lon_cos", "doy_sin", "doy_cos"] + [
    f"basin_{code}" for code in BASIN_CODES
]
TARGET = "argo_salinity"


def add_features(df: DataFrame) -> DataFrame:
    """Add the yearly and longitude cycles and the basin one-hots."""
    doy_sin, doy_cos = yearly_cycle(F.col("sat_datetime"))
    lon_sin, lon_cos = longitude_cycle(F.col("sat_lon"))
    return df.withColumns(
        {
            "doy_sin": doy_sin,
            "doy_cos": doy_cos,
            "lon_sin": lon_sin,
            "lon_cos": lon_cos,
            **{f"basin_{code}": one_hot(F.col("sat_oceanBasin"), code) for code in BASIN_CODES},
        }
    )


def add_residual(df: DataFrame) -> DataFrame:
    """Add ``residual``, the training target of the network."""
    return df.withColumn("residual", residual(F.col(TARGET), F.col("sat_sss")))
