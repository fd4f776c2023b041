"""Z-scores with training statistics only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations: two numbers per feature, held by the driver."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        scaled = {
            f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.means, self.stds)
        }
        return df.withColumns(scaled)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, float(m), float(s)) for c, m, s in zip(self.columns, self.means, self.stds)]
        return spark.createDataFrame(rows, "feature string, mean double, std double")


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    """One aggregate over (feature, value) rows; a constant column gets deviation 1.

    The long form keeps the generated code small enough to be compiled however many
    features there are.  Constancy is told by the extremes: merged partial variances need
    not be exactly zero.
    """
    values = train.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("i", "v"))
    stats = values.groupBy("i").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    means, stds = [0.0] * len(columns), [1.0] * len(columns)
    found = stats.collect()
    if len(found) < len(columns) or any(s.mean is None for s in found):
        raise ValueError("no training rows")
    for s in found:
        constant = s.low == s.high
        means[s.i] = s.low if constant else s.mean
        stds[s.i] = 1.0 if constant else s.std
    return Scaler(tuple(columns), tuple(means), tuple(stds))
