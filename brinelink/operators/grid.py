"""Counts and errors on a regular latitude/longitude grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinelink.functions.scalars import log10_count

# Grid cell size in degrees and rows needed before a cell is shown.
BIN_DEG = 5.0
MIN_COUNT = 5


def grid_index(lat: Column, lon: Column, bin_deg: float = BIN_DEG, clip: bool = False) -> tuple[Column, Column]:
    """(lat_idx, lon_idx); values on or past the last edge fall in the last cell.

    Longitudes are first brought into [-180, 180), 180 itself excepted.  With ``clip``
    they are taken as they come and anything past an edge goes to the edge cell.
    """
    n_lat, n_lon = math.ceil(180.0 / bin_deg), math.ceil(360.0 / bin_deg)
    if not clip:
        lon = F.when(lon.between(-180.0, 180.0), lon).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)

    def bounded(x: Column, n: int) -> Column:
        return F.least(F.greatest(F.floor(x), F.lit(0).cast("long")), F.lit(n - 1).cast("long")).cast("int")

    return bounded((lat + 90.0) / bin_deg, n_lat), bounded((lon + 180.0) / bin_deg, n_lon)


def with_grid(df: DataFrame, lat: str, lon: str, bin_deg: float = BIN_DEG, clip: bool = False) -> DataFrame:
    """Add lat_idx, lon_idx; rows without coordinates are dropped."""
    lat_idx, lon_idx = grid_index(F.col(lat), F.col(lon), bin_deg, clip)
    return df.dropna(subset=[lat, lon]).withColumn("lat_idx", lat_idx).withColumn("lon_idx", lon_idx)


def grid_stats(
    df: DataFrame,
    lat: str,
    lon: str,
    diff: Column,
    bin_deg: float = BIN_DEG,
    min_count: int = MIN_COUNT,
    by: Sequence[str] = (),
    clip: bool = False,
) -> DataFrame:
    """Per cell: n, bias and rmse, the errors NULL below ``min_count`` rows."""
    cells = (
        with_grid(df.withColumn("diff", diff), lat, lon, bin_deg, clip)
        .groupBy(*by, "lat_idx", "lon_idx")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("bias"), F.sqrt(F.avg(F.col("diff") ** 2)).alias("rmse"))
    )
    shown = F.col("n") >= min_count
    return cells.withColumn("bias", F.when(shown, F.col("bias"))).withColumn("rmse", F.when(shown, F.col("rmse")))


def dense_grid(spark: SparkSession, cells: DataFrame, bin_deg: float = BIN_DEG) -> DataFrame:
    """Every cell of the globe, empty ones with n = 0 and NULL elsewhere."""
    n_lat, n_lon = math.ceil(180.0 / bin_deg), math.ceil(360.0 / bin_deg)
    frame = spark.range(n_lat * n_lon).select(
        F.floor(F.col("id") / n_lon).cast("int").alias("lat_idx"), (F.col("id") % n_lon).cast("int").alias("lon_idx")
    )
    return frame.join(cells, ["lat_idx", "lon_idx"], "left").na.fill(0, ["n"])


def grid_density(df: DataFrame, lat: str, lon: str, by: Sequence[str] = (), bin_deg: float = BIN_DEG) -> DataFrame:
    """Per cell: n and its log10."""
    counts = with_grid(df, lat, lon, bin_deg).groupBy(*by, "lat_idx", "lon_idx").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("log10_n", log10_count(F.col("n")))


def split_density(df: DataFrame, lat: str = "sat_lat", lon: str = "sat_lon") -> DataFrame:
    """Train and test density per sensor and cell on a common scale.

    Expects ``sensor`` and ``partition``.  ``vmax`` is the largest log10 count of the
    sensor; its window runs over grid cells only.
    """
    counts = (
        with_grid(df, lat, lon)
        .groupBy("sensor", "lat_idx", "lon_idx")
        .agg(
            F.count_if(F.col("partition") == "train").alias("n_train"),
            F.count_if(F.col("partition") == "test").alias("n_test"),
        )
        .where((F.col("n_train") > 0) | (F.col("n_test") > 0))
    )
    logs = counts.withColumn("log10_train", log10_count(F.col("n_train"))).withColumn(
        "log10_test", log10_count(F.col("n_test"))
    )
    top = F.max(F.greatest("log10_train", "log10_test")).over(Window.partitionBy("sensor"))
    return logs.withColumn("vmax", top)


def coverage_density(everything: DataFrame, matched: dict[str, DataFrame]) -> DataFrame:
    """All profiles against each sensor's matched ones, per cell, on a common scale.

    ``everything`` holds lat, lon; each matched table argo_lat, argo_lon.
    """
    tagged = everything.select("lat", "lon", F.lit("all").alias("source"))
    for sensor, table in matched.items():
        tagged = tagged.unionByName(
            table.select(F.col("argo_lat").alias("lat"), F.col("argo_lon").alias("lon"), F.lit(sensor).alias("source"))
        )
    names = ["all", *matched]
    counts = with_grid(tagged, "lat", "lon").groupBy("lat_idx", "lon_idx").agg(
        *[F.count_if(F.col("source") == name).alias(f"n_{name}") for name in names]
    )
    logs = counts.select("*", *[log10_count(F.col(f"n_{name}")).alias(f"log10_{name}") for name in names])
    top = F.max(F.greatest(*[f"log10_{name}" for name in names])).over(Window.partitionBy(F.lit(0)))
    return logs.withColumn("vmax", top)


def geographic_error(full: DataFrame, test: DataFrame, pred: str, actual: str = "argo_salinity") -> DataFrame:
    """Raw error on every matchup beside corrected error on held-out rows, per cell.

    Returns source ('raw' or 'corrected'), lat_idx, lon_idx, n, bias, rmse.
    """
    raw = full.select("sat_lat", "sat_lon", (F.col("sat_sss") - F.col(actual)).alias("d"), F.lit("raw").alias("source"))
    corrected = test.select(
        "sat_lat", "sat_lon", (F.col(pred) - F.col(actual)).alias("d"), F.lit("corrected").alias("source")
    )
    return grid_stats(raw.unionByName(corrected), "sat_lat", "sat_lon", F.col("d"), by=["source"])


def display_scale(cells: DataFrame) -> DataFrame:
    """95th percentile of abs(bias) and of rmse over all shown cells; a grid is small, so exact."""
    return cells.agg(
        F.percentile(F.abs("bias"), F.lit(0.95)).alias("bias_scale"),
        F.percentile("rmse", F.lit(0.95)).alias("rmse_scale"),
    )
