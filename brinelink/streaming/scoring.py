"""Correcting satellite observations as they arrive.

Quality rules and scoring are stateless, so the batch functions apply to a stream as they
are; no watermark or state is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brinelink.models.network import Network, score
from brinelink.models.scaler import Scaler
from brinelink.operators.features import add_features
from brinelink.operators.profiles import usable_sat


def correct_stream(sat: DataFrame, sensor: str, network: Network, scaler: Scaler) -> DataFrame:
    """Usable observations of a (streaming) satellite table with their corrected value."""
    named = usable_sat(sat, sensor).select(
        F.col("lat").alias("sat_lat"),
        F.col("lon").alias("sat_lon"),
        F.col("datetime").alias("sat_datetime"),
        F.col("oceanBasin").alias("sat_oceanBasin"),
        F.col("sss").alias("sat_sss"),
    )
    return score(add_features(named), network, scaler).select(*named.columns, "pred_ffann")


def write_corrected(corrected: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet; each input file is taken in exactly once."""
    return (
        corrected.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
