"""Error metrics of predictions, overall and broken down."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latitude bands as half-open intervals; 90 itself lies in none of them.
LAT_BANDS = ((-90, -60), (-60, -30), (-30, 30), (30, 60), (60, 90))


def metric_columns(pred: Column, actual: Column) -> list[Column]:
    """n, rmse, bias and corr over rows where both values are known.

    The correlation is NULL where it is undefined (one row, or no variance); lack of
    variance is told by the extremes, since merged partial variances need not be exactly 0.
    """
    known = pred.isNotNull() & actual.isNotNull()
    p, a = F.when(known, pred), F.when(known, actual)
    diff = p - a
    varies = (F.min(p) < F.max(p)) & (F.min(a) < F.max(a))
    corr = F.try_divide(F.covar_pop(p, a), F.stddev_pop(p) * F.stddev_pop(a))
    return [
        F.count(diff).alias("n"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.avg(diff).alias("bias"),
        F.when(varies, corr).alias("corr"),
    ]


def error_metrics(df: DataFrame, pred: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(F.col(pred), F.col(actual)))


def long_predictions(df: DataFrame, methods: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, method): ``keep`` columns, ``method``, ``pred``."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("method"), F.col(col).alias("pred")) for name, col in methods.items()]
    )
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.method", "p.pred")


def lat_band(lat: Column) -> Column:
    """struct(lat_lo, lat_hi) of the band holding a latitude, NULL outside all bands."""
    band = F.lit(None).cast("struct<lat_lo:int,lat_hi:int>")
    for lo, hi in LAT_BANDS:
        inside = (lat >= lo) & (lat < hi)
        band = F.when(inside, F.struct(F.lit(lo).alias("lat_lo"), F.lit(hi).alias("lat_hi"))).otherwise(band)
    return band


def metrics_by_lat_band(df: DataFrame, pred: str, actual: str, lat: str = "sat_lat", by: Sequence[str] = ()) -> DataFrame:
    """Metrics per latitude band; a band without rows does not appear."""
    banded = df.withColumn("band", lat_band(F.col(lat))).where(F.col("band").isNotNull())
    return error_metrics(banded.select("*", "band.*"), pred, actual, [*by, "lat_lo", "lat_hi"])


def metrics_by_basin(
    df: DataFrame, pred: str, actual: str, basin: str = "sat_oceanBasin", by: Sequence[str] = ()
) -> DataFrame:
    """Metrics per basin; rows of unknown basin are left out."""
    return error_metrics(df.where(F.col(basin).isNotNull()), pred, actual, [*by, basin])


def metrics_by_group(df: DataFrame, methods: Mapping[str, str], actual: str, group: str) -> DataFrame:
    """Metrics of several predictions per group and overall, in one pass."""
    rows = long_predictions(df, methods, [group, actual])
    tagged = rows.withColumn("group", F.explode(F.array(F.lit("overall"), F.col(group)))).where(
        F.col("group").isNotNull()
    )
    return error_metrics(tagged, "pred", actual, ["method", "group"])


def improvement_over(metrics: DataFrame, baseline: str, by: Sequence[str] = ()) -> DataFrame:
    """Relative drop of rmse against the baseline method, in percent.

    ``metrics`` is a small table: one row per method and group.
    """
    base = metrics.where(F.col("method") == baseline).select(*by, F.col("rmse").alias("base_rmse"))
    joined = metrics.join(base, list(by)) if by else metrics.join(F.broadcast(base), F.lit(True))
    return joined.select(
        *by,
        "method",
        "n",
        "rmse",
        "base_rmse",
        (F.try_divide(F.col("base_rmse") - F.col("rmse"), F.col("base_rmse")) * 100.0).alias("improvement_pct"),
    )
